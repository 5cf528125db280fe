"""Best-fit packing of tokenised documents into sequences, planned on a histogram of lengths.

Lengths are at most the capacity, so their histogram is small whatever the corpus: best-fit
decreasing runs on counts of lengths and of open sequences by room left. The plan says, for each
length, which ranks go to which sequences; pieces then take their slots by a join on their
length and rank. Ranks are counted in salted parts of a length, so that a length that a third
of all pieces share is no single task's work.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts_of, written
from .words import buffers

CAPACITY = 4096
END_ID = 1
#: Pieces that a worker keeps encoded: so many since it last put the older ones behind.
CACHE = 150_000
#: A part of a length has about so many pieces; there are MIN_SALTS parts at least.
PART_ROWS, MIN_SALTS = 1_000_000, 64
#: Plans of more rows than this aren't broadcast.
PLAN_ROWS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Text of these characters is put in lower case and cut here; other words are left to the library whole. "<|" begins its special tokens.
_PLAIN = re.compile("[\\t-\\r -~À-ÖØ-öø-ÿ]*")
#: How the vocabulary cuts text, for plain characters.
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
#: How byte-level vocabularies write bytes: visible ones of Latin-1 as they are, the others from 256 on, in order.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_WRITTEN = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SEEN)}


class Kept:
    """A cache that forgets what wasn't asked for in a while: of two halves, the older goes when the newer is full."""

    def __init__(self, size: int = CACHE):
        self.size, self.new, self.old = size, {}, {}

    def fetch(self, keys: set, make) -> dict:
        """Values of all the keys; make(keys) gives those of keys that aren't kept."""
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new
        missing = keys - self.new.keys()
        again = missing & self.old.keys()
        for k in again:
            self.new[k] = self.old[k]
        if missing := missing - again:
            self.new.update(make(missing))
        return self.new


class WordTokenizer:
    """A tokenizer for which white space only separates: each piece of a word is encoded once and kept.

    Plain text is cut into pieces, which the vocabulary's own BPE encodes; words with other characters go
    through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kept = Kept()

    def _made(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces; of whole words, behind a line feed, by the library."""
        bpe, odd = self.library.model.tokenize, [x for x in pieces if x[0] == "\n"]
        out = {x: array("I", [t.id for t in bpe(x if x.isascii() else x.encode().decode("latin-1").translate(_WRITTEN))]).tobytes() for x in pieces.difference(odd)}
        for x, e in zip(odd, self.library.encode_batch_fast([x[1:] for x in odd], add_special_tokens=False), strict=True):
            out[x] = array("I", e.ids).tobytes()
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _CUT.findall(text.lower())
        out = []
        for w in re.split("[\t-\r ]+", text):
            if w:
                out += _CUT.findall(w.lower()) if _PLAIN.fullmatch(w) and "<|" not in w else ["\n" + w]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        cut = [self._cut(t.decode("utf-8", "replace")) for t in texts]
        ids = self.kept.fetch(set(chain.from_iterable(cut)), self._made)
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in cut]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document's ids with the end id after them.

    Null texts count as empty and have the end id alone. Only documents of more than `capacity` ids
    are cut, and only their last piece may be shorter. Repeated rows have their pieces each; null doc_ids stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t, end = tokenizer(vocabulary), struct.pack("<I", end_id)
        for batch in batches:
            texts, at, rows = [x or b"" for x in batch.column("text").to_pylist()], [], []
            for low, some in buffers(texts):
                for i, ids in enumerate(t.encode(some), low):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        at.append(i)
                        rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 4
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, per sequence, first sequence, offset).

    Of a row, rank r >= first goes to sequence first + (r - first) // per at the offset
    offset + (r - first) % per * length. Open sequences are kept as runs (first number, how many)
    by the room they have left, so the work depends on the number of different lengths.
    """
    rooms: list[int] = []  # the different rooms, ascending
    runs: dict[int, list[tuple[int, int]]] = {}
    rows, used = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in runs:
                insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"no sequence holds a piece of length {length}")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room = capacity
                first, n = used, -(-left // (room // length))
                used += n
            per = room // length
            full, odd = divmod(min(left, n * per), per)
            took = full * per + odd
            rows.append((length, rank, took, per, first, capacity - room))
            put(room - per * length, first, full)
            if odd:
                put(room - odd * length, first + full, 1)
            put(room, first + full + bool(odd), n - full - bool(odd))
            rank, left = rank + took, left - took
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """pieces (doc_id, piece, length and any others) with sequence_id and offset.

    Equal rows may take each other's slots. No pieces give no rows.
    """
    spark = pieces.sparkSession
    salts = max(MIN_SALTS, math.ceil(pieces.count() / part_rows))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    # at most capacity x salts rows, by length
    parts = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = written(parts, "ranks")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    rows = plan(histogram, capacity)
    slots = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "length long, first long, n long, per long, sequence long, at long").withColumnRenamed("length", "of_length")
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
        .join(parts.select(F.col("length").alias("l"), F.col("salt").alias("s"), "before"), (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    if len(rows) <= PLAN_ROWS:
        slots = F.broadcast(slots)
    placed = ranked.join(slots, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        *pieces.columns,
        (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Null and empty texts are one piece of the end id; null doc_ids stay null; repeated rows are documents of their own, each with
    its pieces; pieces of equal length take slots in any order. An empty table has no pieces.
    """
    return pack(written(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
