"""Words of many texts at once, as 64-bit hashes: texts stay bytes and no word becomes a Python object.

A word is a run of bytes other than ASCII white space, with A-Z in lower case. Its hash takes eight bytes at a
time, the same step of all words together; that of a word of more than SHORT bytes is a polynomial over its
bytes, taken from running sums, so that a very long one is no loop. Where a word stands doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Bytes of texts that are taken together, and of one text that are hashed together.
BUFFER = 1 << 18
#: The longest words that are hashed eight bytes at a time.
SHORT = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, x, dtype=np.uint64)]) for x in (base, pow(base, -1, 1 << 64)))


#: What is left of eight bytes, of which a word has so many.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _short(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hashes of words of n bytes, at most SHORT, that start there; data goes on for 8 bytes after them."""
    eights = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    hashes = mixed((eights[starts] & _LEFT[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more = np.flatnonzero(n > 8)
    for k in range(8, SHORT, 8):
        hashes[more] = mixed(hashes[more] + (eights[starts[more] + k] & _LEFT[np.minimum(n[more] - k, 8)]))
        more = more[n[more] > k + 8]
    return hashes


def _long(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of longer words."""
    hashes = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BUFFER, side="right")))
        part = mixed(data[low : ends[j - 1]].astype(np.uint64) + np.uint64(1))
        base, inverse = _powers(max(BUFFER, 1 << (len(part) - 1).bit_length()))
        sums = np.r_[np.uint64(0), np.cumsum(part * base[: len(part)], dtype=np.uint64)]
        hashes[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * inverse[starts[i:j] - low]
        i = j
    return mixed(hashes)


class Words(NamedTuple):
    """The words of texts one after another: their hashes, their text's number, and their line's number in all texts."""

    hashes: np.ndarray
    text: np.ndarray
    line: np.ndarray
    #: The number of each text's first line.
    first_line: np.ndarray


def _numbers(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of at, which are sorted, lie before each of starts, which are too."""
    return np.repeat(np.arange(len(at) + 1), np.diff(np.r_[0, np.searchsorted(starts, at), len(starts)]))


def words_of(texts: list[bytes]) -> Words:
    whole = b"\n".join(texts)
    data = np.frombuffer(whole.lower() + bytes(8), dtype=np.uint8)
    inside = np.zeros(len(whole) + 2, dtype=bool)
    inside[1:-1] = ~((data[:-8] == 0x20) | (data[:-8] - np.uint8(0x09) < 5))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = ends - starts
    hashes = np.empty(len(starts), dtype=np.uint64)
    long = n > SHORT
    if long.any():
        hashes[long] = _long(data, starts[long], ends[long])
        hashes[~long] = _short(data, starts[~long], n[~long])
    else:
        hashes = _short(data, starts, n)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    breaks = np.flatnonzero(data == 10)
    return Words(hashes, _numbers(at[1:], starts), _numbers(breaks, starts), np.searchsorted(breaks, at))


def buffers(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in their order, in parts of some BUFFER bytes, each with the number of its first text."""
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > BUFFER:
            yield low, texts[low : i + 1]
            low, size = i + 1, 0
    if low < len(texts):
        yield low, texts[low:]
