"""SentencePiece pieces, spans and texts as the library gives them, with and without a character map."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodestone.llm import sentence_piece

MODEL = P.path("piece_bpe_32k.model")
SIGNS = " 　▁\n\tabéßABth日本🙂\x00<s>/½ﬁ​0123.,'①㍿が゙ﬀ﻿𝐀ℌＡ"


def texts(n, seed, most=50):
    rng = random.Random(seed)
    return ["", " ", "  a\n\nb\t ", "<s> </s>", "▁▁ a", "  x"] + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(most))) for _ in range(n)]


def same(ours, theirs, some):
    for t in some:
        ids = theirs.encode(t)
        assert ours.encode(t) == ids
        assert ours.decode(ids) == theirs.decode(ids)
        whole, spans = t.encode(), ours.spans(t, np.array(ids, dtype=int))
        assert [whole[a:b].decode() for a, b in spans] == [p.surface for p in theirs.encode(t, return_type="proto").pieces]


def test_pieces_as_the_library():
    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentence_piece.Pieces.from_file(MODEL)
    same(ours, theirs, texts(1500, 1) + ["x" * 5000, "日本語" * 2000, " " * 100, "ab" * 3000, "<>" * 200])
    assert ours.encode("a b", ends=True) == theirs.encode("a b", add_bos=True, add_eos=True)
    rng = random.Random(2)
    for _ in range(1000):  # ids of no text
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259)]) for _ in range(rng.randrange(8))]
        assert ours.decode(ids) == theirs.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("by_bytes", [True, False])
def test_character_maps_as_the_library(rule, trim, by_bytes):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model, other = pb.ModelProto(), pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.CopyFrom(other.normalizer_spec)
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = True, trim, True
    model.trainer_spec.byte_fallback = by_bytes
    for p in [] if by_bytes else [p for p in model.pieces if p.type == 6]:
        p.type = 1
    data = model.SerializeToString()
    same(sentence_piece.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data), texts(400, 3, 25))


def test_round_trip(spark):
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate(texts(50, 4))] + [(100, None), (None, "no id"), (101, "word " * 50_000), (101, "word " * 50_000)]
    found = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("n_tokens"), F.lit(3).alias("Doc_Id"))
    want = []
    for i, t in rows:
        ids = theirs.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert sorted(map(tuple, sentence_piece.round_trip(found, MODEL).collect()), key=repr) == sorted(want, key=repr)
    assert sentence_piece.round_trip(found.limit(0), MODEL).collect() == []
    pieces = {r.doc_id: r.pieces for r in sentence_piece.encode_documents(found, MODEL).collect()}
    assert pieces[0] == pieces[100] == [] and [(p.begin, p.end) for p in pieces[2]][-1][1] == len(rows[2][1].encode())


def test_round_trip_of_the_whole_table(spark):
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: hashlib.sha256(np.array(theirs.encode(r.text or "", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for r in found.collect()}
    assert {r.doc_id: r.ids_sha256 for r in sentence_piece.round_trip(found, MODEL).collect()} == want
