"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece of bytes, exactly one token can end its encoding: the merges of BPE
leave one valid token sequence, and a sequence is valid iff each pair of neighbours is. So the
encoder stores one number for each prefix, its last token: the longest token that ends there,
whose own prefix's last token it may follow. Appending bytes extends the table; an edit keeps
the table before it, and the one after it from where both tables agree again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Pieces of text that each worker keeps encoded; beyond that many it starts anew.
CACHE = 1_000_000
#: White space that Python and the pattern's engine take differently, or that isn't ASCII.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: A run of white space and what follows it up to the next one.
CHUNK = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")


class BytePairs:
    """Encoder and decoder of one table of ranks (token bytes: rank; a rank is an id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts = {}  # id: the two ids that it was merged from
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def split(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge made a token; None for one byte (or if no merges make it)."""
        if token not in self.parts:
            whole, parts = self.tokens[token], None
            pieces = [self.ranks[whole[i : i + 1]] for i in range(len(whole))]
            # the merges below the token's own rank leave the pair that it is made of
            while len(pieces) > 2:
                rank, at = min(((self.ranks.get(self.tokens[a] + self.tokens[b], token), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False))))
                if rank >= token:
                    break
                pieces[at : at + 2] = [rank]
            if len(pieces) == 2:
                parts = (pieces[0], pieces[1])
            self.parts[token] = parts
        return self.parts[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side when it encodes their joined bytes."""
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) > CACHE:
                self.fits.clear()
            self.fits[key] = self._may_follow(left, right)
        return self.fits[key]

    def _may_follow(self, left: int, right: int) -> bool:
        # Undo merges, latest first, and see at each state whether a merge over the border
        # comes before the merges that made what stands there now.
        limit = 1 << 62
        while True:
            over = self.ranks.get(self.tokens[left] + self.tokens[right])
            if over is not None and over < limit:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:  # a merge over the border of the same rank stands further left, so it comes first
                limit, right = right + 1, b[0]

    def extend(self, data: bytes, last: list[int], start: int) -> list[int]:
        """Fills in the last tokens of the prefixes of data that are longer than start bytes."""
        ranks, fits = self.ranks, self.may_follow
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = ranks.get(data[begin:end])
                if token is not None and (begin == 0 or fits(last[begin - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the ranks lack a byte")
        return last

    def table(self, data: bytes) -> list[int]:
        """The last token of each prefix."""
        return self.extend(data, [], 0)

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The table of data + more, from that of data."""
        return data + more, self.extend(data + more, list(last), len(data))

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The table of data with data[start:end] replaced by new; only places near it are encoded again.

        A prefix's last token depends on the last tokens of at most `longest` bytes before it, so
        the old table holds again once so many places in a row agree with it.
        """
        edited, moved = data[:start] + new + data[end:], len(new) - (end - start)
        out, same = list(last[:start]), 0
        while len(out) < len(edited):
            self.extend(edited[: len(out) + 1], out, len(out))
            at = len(out) - 1 - moved
            past = len(out) > start + len(new)
            same = same + 1 if past and 0 <= at < len(last) and last[at] == out[-1] else 0
            if same >= self.longest:
                return edited, out + last[at + 1 :]
        return edited, out

    def walk(self, last: list[int]) -> list[int]:
        """The ids of the whole, from the last tokens of its prefixes."""
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        return self.walk(self.table(piece.encode("utf-8")))

    def _ids(self, piece: str) -> bytes:
        """The ids of one chunk of text as little-endian 32-bit numbers, kept for the next time."""
        found = self.pieces.get(piece)
        if found is None:
            parts = self.pattern.findall(piece)
            if len(parts) > 1:
                found = b"".join(map(self._ids, parts))
            else:
                found = np.array([i for p in parts for i in self.encode_piece(p)], dtype="<u4").tobytes()
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = found
        return found

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text. Every match of the pattern starts at a run of white space or within
        what follows it, so chunks that begin at such runs are encoded one by one."""
        if ODD_SPACE.search(text):
            return b"".join(map(self._ids, self.pattern.findall(text)))
        get, own = self.pieces.get, self._ids
        return b"".join([get(c) or own(c) for c in CHUNK.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairs:
    """Each worker reads a vocabulary once."""
    return BytePairs.from_file(path, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>): the token ids of each whole text; null counts as empty, which has none."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        e = encoder(vocabulary, pattern)
        return pd.Series([np.frombuffer(e.encode_bytes(t or ""), dtype="<u4").astype("int32") for t in texts])

    return pick(docs, doc_id="long", text="string").select("doc_id", ids("text").alias("ids"))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids alone.

    One row for each row of docs, in no exchange. Null texts count as empty (no ids); extra
    columns are ignored; repeated rows are each encoded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary, pattern)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = e.encode_bytes(text or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(np.frombuffer(ids, dtype="<u4").tolist())).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": pd.Series(n, dtype="int64"), "ids_sha256": a, "decoded_sha256": b})

    # ids travel as text: pandas would hold a long column with nulls as doubles
    rows = pick(docs, doc_id="string", text="string").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
