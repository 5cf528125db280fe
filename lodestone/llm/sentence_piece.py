"""SentencePiece encoding and decoding by the vocabulary of a BPE model, with each piece's span of source bytes.

A text is normalised by longest prefixes through the model's compiled character map (a double-array trie whose
leaves point to replacements), and for each byte of the normal form the place of the source that it comes from is kept.
So every piece is projected to the bytes of the original that it stands for. Pieces never hold a word mark after
another character, hence a normal form is encoded word by word; inside a word merges can't cross two characters
that no piece has side by side, so what is merged at once is short however long a text without spaces is.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Words that each worker keeps encoded; beyond that many it starts anew. Longer ones than KEPT aren't kept.
CACHE, KEPT = 1_000_000, 64
#: Words of more characters are cut where no merge crosses, and merged with the help of a heap.
SHORT = 40
# Fixed values of the model's format: the mark of a space, what stands for bytes that are no UTF-8, and types of pieces.
MARK, INVALID = "▁", "�"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a protocol buffer's message; fixed-width and nested values as bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """A compiled character map: a double-array trie over source bytes, and the replacements its leaves point to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units, self.texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix there that the map has, and that prefix's length."""
        units, found = self.units, None
        step = lambda unit: unit >> 10 << ((unit & 512) >> 6)
        node = step(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, end + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class Pieces:
    """Encoder and decoder of one BPE model; models with pieces of the user's own aren't supported."""

    def __init__(self, model: bytes):
        top = list(message(model))
        one = lambda number: dict(message(next((v for k, v in top if k == number), b"")))
        trainer, normal = one(2), one(3)
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        self.map = CharMap(normal[2]) if normal.get(2) else None
        self.prefix, self.trim, self.escape = bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1))
        self.suffix, self.by_bytes = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        parts = [dict(message(v)) for k, v in top if k == 1]
        self.names, self.kinds = [p[1].decode() for p in parts], [p.get(3, NORMAL) for p in parts]
        if USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("pieces of the user's own or unused ones aren't supported")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == NORMAL}
        self.packed = {t: struct.pack("<I", i) for t, i in self.ids.items()}
        self.rank = {self.names[i]: -struct.unpack("<f", parts[i].get(2, bytes(4)))[0] for i in self.ids.values()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.begin, self.end = self.names.index("<s>"), self.names.index("</s>")
        self.bytes = {int(self.names[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.beside = {a + b for t in self.ids for a, b in pairwise(t)}
        by_word = all(MARK not in t.lstrip(MARK) for t in self.ids)
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if by_word else "(?s).+")
        #: What an id is in the normal form, in bytes; bytes of a character count at its last one, unknown ones aren't told.
        self.size = np.array([len(t.encode()) if k == NORMAL else 0 for t, k in zip(self.names, self.kinds, strict=True)])
        #: Of an id that stands for a character's first byte, how many bytes the character has.
        self.lead = np.array([0 if k != BYTE or 0x80 <= (b := int(t[3:5], 16)) < 0xC0 else 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for t, k in zip(self.names, self.kinds, strict=True)])
        self.text = [b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else self.unknown_text if k == UNKNOWN else t.replace(MARK, " ").encode() for t, k in zip(self.names, self.kinds, strict=True)]
        self.words: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        with open(path, "rb") as file:
            return cls(file.read())

    # Normalisation

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the prefix of data there, and that prefix's length: the map's longest one, or a character."""
        found = self.map.longest(data, at) if self.map else None
        if found:
            return found
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size], size

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normal form, and for each of its bytes, and its end, the byte of the text's UTF-8 that it comes from."""
        data = text.encode()
        at, out, places = 0, bytearray(), []
        mark = MARK.encode() if self.escape else b" "

        def add(some: bytes) -> None:
            some = some.replace(b" ", mark)
            out.extend(some)
            places.extend([at] * len(some))

        while self.trim and at < len(data):  # spaces at the beginning
            some, size = self._prefix(data, at)
            if some != b" ":
                break
            at += size
        if at == len(data):
            return "", np.array([at])
        if self.prefix and not self.suffix:
            add(b" ")
        after_space = self.trim
        while at < len(data):
            some, size = self._prefix(data, at)
            if after_space:
                some = some.lstrip(b" ")
            if some:
                add(some)
                after_space = self.trim and some.endswith(b" ")
            at += size
        while self.trim and out.endswith(mark):  # and at the end
            del out[-len(mark) :]
            at = places[len(out)]
            del places[len(out) :]
        if self.prefix and self.suffix:
            add(b" ")
        return out.decode("utf-8", "replace"), np.array([*places, at])

    def _plain(self) -> bool:
        return self.map is None and not self.trim and self.escape and not self.suffix

    def normal(self, text: str) -> str:
        """The normal form alone."""
        if not self._plain():
            return self.normalize(text)[0]
        return ((MARK if self.prefix else "") + text).replace(" ", MARK) if text else ""

    def alignment(self, text: str) -> np.ndarray:
        """As normalize() tells it."""
        if not self._plain():
            return self.normalize(text)[1]
        data = np.frombuffer(text.encode(), np.uint8)
        width = np.where(data == 0x20, len(MARK.encode()), 1)
        places = np.repeat(np.arange(len(data)), width)
        return np.r_[np.zeros(len(MARK.encode()) if self.prefix and len(data) else 0, np.int64), places, len(data)]

    # Encoding

    def _short(self, word: str) -> list[str]:
        """The pieces of a word: of neighbours the pair of the best rank is merged, the leftmost of equal ones first."""
        parts, rank, none = list(word), self.rank.get, float("inf")
        ranks = [rank(a + b, none) for a, b in pairwise(word)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [whole] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + whole, none)
            if i < len(ranks):
                ranks[i] = rank(whole + parts[i + 1], none)
        return parts

    def _long(self, word: str) -> list[str]:
        """The same for a word of many characters, with the pairs in a heap."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        rank = self.rank.get
        heap = [(r, i, a + b) for i, (a, b) in enumerate(pairwise(word)) if (r := rank(a + b)) is not None]
        heapify(heap)
        while heap:
            _, i, whole = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != whole:
                continue  # one of them has been merged since
            parts[i], parts[j] = whole, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (r := rank(whole + parts[k])) is not None:
                    heappush(heap, (r, i, whole + parts[k]))
            h = before[i]
            if h >= 0 and (r := rank(parts[h] + whole)) is not None:
                heappush(heap, (r, h, parts[h] + whole))
        return [p for p in parts if p is not None]

    def _pieces(self, word: str) -> list[str]:
        if len(word) <= SHORT:
            return self._short(word)
        cuts = [0, *(i for i, (a, b) in enumerate(pairwise(word), 1) if a + b not in self.beside), len(word)]
        return [p for low, high in pairwise(cuts) for p in (self._short if high - low <= SHORT else self._long)(word[low:high])]

    def _word(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit numbers, kept for the next time."""
        found = b"".join([self.packed.get(p) or self._unknown(p) for p in self._pieces(word)])
        if len(self.words) >= CACHE:
            self.words.clear()
        if len(word) <= KEPT:
            self.words[word] = found
        return found

    def _unknown(self, part: str) -> bytes:
        return b"".join(struct.pack("<I", self.bytes[b]) for b in part.encode()) if self.by_bytes else struct.pack("<I", self.unknown)

    def encode_bytes(self, text: str, ends: bool = False) -> bytes:
        """The ids of a text as little-endian 32-bit numbers; with ends those of its begin and end as well."""
        get, own = self.words.get, self._word
        found = b"".join([get(c) or own(c) for c in self.chunks.findall(self.normal(text))])
        if not self.by_bytes:  # unknown characters side by side are one
            ids = np.frombuffer(found, "<u4")
            found = ids[np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)][: len(ids)]].tobytes()
        return struct.pack("<I", self.begin) + found + struct.pack("<I", self.end) if ends else found

    def encode(self, text: str, ends: bool = False) -> list[int]:
        return np.frombuffer(self.encode_bytes(text, ends), "<u4").tolist()

    def spans(self, text: str, ids: np.ndarray, align: np.ndarray | None = None) -> np.ndarray:
        """(begin, end) in the text's UTF-8 of each of its ids, without begin and end ids.

        Of several bytes that stand for one character the last one has its span, those before it are empty.
        """
        align = self.alignment(text) if align is None else align
        size = self.size[ids]
        lead = np.flatnonzero(self.lead[ids])
        size[lead + self.lead[ids[lead]] - 1] = self.lead[ids[lead]]
        if (ids == self.unknown).any():
            norm, at = self.normal(text).encode(), 0
            for i, own in enumerate(ids.tolist()):
                if own == self.unknown:  # up to what the next known piece stands at
                    rest = norm[at:].decode()
                    size[i] = len(rest[: next((k for k, c in enumerate(rest) if c in self.ids), len(rest))].encode())
                at += int(size[i])
        ends = np.cumsum(size)
        return np.column_stack([align[ends - size], align[ends]])

    # Decoding

    def decode(self, ids) -> str:
        """The text of ids: the space that the encoder puts first goes, each byte that is no UTF-8 is told by a mark."""
        ids = list(ids)
        out = [self.text[i] for i in ids]
        for k, i in enumerate(ids if self.prefix or self.trim else ()):
            if self.kinds[i] == NORMAL and out[k].startswith(b" "):
                out[k] = out[k][1:]
                if not self.trim:
                    break
            if out[k]:
                break
        try:
            return b"".join(out).decode()
        except UnicodeDecodeError:
            return b"".join(out).decode("utf-8", "lodestone-each-byte")


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return INVALID, error.start + 1


codecs.register_error("lodestone-each-byte", _each_byte)


@lru_cache(maxsize=2)
def encoder(path: str) -> Pieces:
    """Each worker reads a model once."""
    return Pieces.from_file(path)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, pieces array<struct<id, begin, end>>): the pieces of each whole text with their spans of its UTF-8.

    Null texts count as empty, which has no pieces; begin and end ids aren't among them.
    """

    @F.pandas_udf("array<struct<id:int,begin:int,end:int>>")
    def pieces(texts: pd.Series) -> pd.Series:
        e = encoder(model)

        def one(text: str | None) -> list[dict]:
            ids = np.frombuffer(e.encode_bytes(text or ""), "<u4")
            return [{"id": int(i), "begin": int(a), "end": int(b)} for i, (a, b) in zip(ids, e.spans(text or "", ids), strict=True)]

        return pd.Series([one(t) for t in texts])

    return pick(docs, doc_id="long", text="string").select("doc_id", pieces("text").alias("pieces"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes): encoded with begin and end ids, then decoded from the ids alone.

    One row for each row of docs, in no exchange. span_bytes sums the pieces' spans: all of the text's bytes, unless the
    model trims spaces. Null texts count as empty (begin and end only); extra columns are ignored; repeated rows are each encoded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(model)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = e.encode_bytes(text or "", ends=True)
                numbers = np.frombuffer(ids, "<u4")
                spans = e.spans(text or "", numbers[1:-1])
                rows.append((len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(numbers.tolist()).encode()).hexdigest(), int((spans[:, 1] - spans[:, 0]).sum())))
            n, a, b, c = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": pd.Series(n, dtype="int64"), "ids_sha256": a, "decoded_sha256": b, "span_bytes": pd.Series(c, dtype="int64")})

    # ids travel as text: pandas would hold a long column with nulls as doubles
    rows = pick(docs, doc_id="string", text="string").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
