"""Zip archives and gzip streams read as far as they are whole, a chunk at a time; for use inside tasks.

An archive's local headers are followed in order and its directory isn't read, so a file that is cut short, or whose directory is
broken, gives all entries before that place. Nothing is held but the archive's own bytes and a chunk of what comes out of it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

ZIP, GZIP = b"PK\x03\x04", b"\x1f\x8b"
#: Bytes that are read at once, and that come out at once.
CHUNK, MOST = 1 << 18, 1 << 20
_MARKS = re.compile(rb"PK(?:\x07\x08|\x03\x04|\x01\x02)")


class Inflated:
    """The chunks of a raw deflate stream; once they are through, where it ended and whether it was whole."""

    def __init__(self, data: memoryview, low: int, high: int):
        self.data, self.low, self.high, self.end, self.whole = data, low, high, low, False

    def __iter__(self) -> Iterator[bytes]:
        z, at = zlib.decompressobj(-15), self.low
        while not z.eof:
            some = z.unconsumed_tail
            if not some:
                some = bytes(self.data[at : min(at + CHUNK, self.high)])
                at += len(some)
                if not some:
                    break
            out = z.decompress(some, MOST)
            if out:
                yield out
        self.whole, self.end = z.eof, at - len(z.unused_data)


class Member(NamedTuple):
    """An entry: where its packed bytes lie, how many come out, and what is wrong with it."""

    name: str
    at: int
    method: int
    low: int
    high: int
    size: int
    problem: str | None

    def chunks(self, data: memoryview) -> Iterable[bytes]:
        return Inflated(data, self.low, self.high) if self.method == 8 else (bytes(data[k : min(k + CHUNK, self.high)]) for k in range(self.low, self.high, CHUNK))


def _stored_end(data: memoryview, low: int) -> int:
    """Where a stored entry of unknown length ends: at a descriptor that tells its length and CRC-32, else at the first place that looks like one."""
    first, crc, upto = None, 0, low
    for found in _MARKS.finditer(data, low):
        at = found.start()
        end, told = (at, at + 4) if found[0][2:] == b"\x07\x08" else (at - 12, at - 12)
        if end < low or told + 8 > len(data):
            continue
        first = end if first is None else first
        want, size = struct.unpack_from("<II", data, told)
        if size == end - low:
            crc = zlib.crc32(data[upto:end], crc) if end >= upto else zlib.crc32(data[low:end])
            upto = max(upto, end)
            if crc == want:
                return end
    return len(data) if first is None else first


def members(data: memoryview) -> Iterator[Member]:
    """The entries of an archive, directories left out. A problem without a name ends the scan."""
    at = 0
    while data[at : at + 4] == ZIP:
        if at + 30 > len(data):
            yield Member("", at, 0, at, at, 0, f"local header cut short at {at}")
            return
        flags, method, packed, n, extra = struct.unpack_from("<6xHH8xI4xHH", data, at)
        low = at + 30 + n + extra
        if low > len(data):
            yield Member("", at, 0, at, at, 0, f"local header cut short at {at}")
            return
        name = bytes(data[at + 30 : at + 30 + n]).decode("utf-8" if flags & 0x800 else "latin-1", "replace")
        open_end = flags & 8 and not packed
        high = len(data) if open_end and method == 8 else _stored_end(data, low) if open_end else low + packed
        if high > len(data):
            yield Member("", at, method, low, low, 0, f"{name} is longer than the file")
            return
        problem, size = None, high - low
        if method == 8:
            stream = Inflated(data, low, high)
            try:
                size = sum(map(len, stream))
                problem = None if stream.whole else f"{name} is cut short"
                high = stream.end if open_end and stream.whole else high
            except zlib.error as e:
                problem = f"{name} can't be inflated: {e}"
            if problem and open_end:  # its end can't be told: the next mark is taken for it
                high = _stored_end(data, low)
        elif method:
            problem = f"{name} has the unknown method {method}"
        if not name.endswith("/"):
            yield Member(name, at, method, low, high, size, problem)
        at = high
        if flags & 8:
            at += 16 if data[at : at + 4] == b"PK\x07\x08" else 12


def gunzipped(chunks: Iterable[bytes], told: list[str]) -> Iterator[bytes]:
    """What comes out of all members of a gzip stream, as far as they are whole; other data as it is. told gets what is wrong."""
    chunks = iter(chunks)
    first = next(chunks, b"")
    if first[:2] != GZIP:
        yield from chain([first], chunks)
        return
    z, kept = zlib.decompressobj(31), b""
    for some in chain([first], chunks):
        some = kept + some
        kept = b""
        while some:
            if z.eof:
                some = some.lstrip(b"\0")  # padding
                if len(some) < 2:
                    kept, some = some, b""
                    break
                if some[:2] != GZIP:
                    told.append("what follows the last gzip member is no other one")
                    return
                z = zlib.decompressobj(31)
            try:
                out = z.decompress(some, MOST)
            except zlib.error as e:
                told.append(f"gzip broken: {e}")
                return
            if out:
                yield out
            some = z.unused_data if z.eof else z.unconsumed_tail
    if not z.eof:
        out = z.flush()
        if out:
            yield out
        told.append("gzip cut short")
    elif kept:
        told.append("what follows the last gzip member is no other one")
