"""Line dedup: an exact set-similarity join of lines, and removal of later matches.

A line is the set of its distinct words (A-Z in lower case, split at ASCII white space); two lines match
if the Jaccard similarity of their sets is at least 0.75. Lines of equal sets are one class. Words are
ordered by rarity: by the count of their bucket (of BUCKETS) over all lines, then by their hash. Any
order gives the exact join; this one keeps prefixes rare. Two sets that match share a word
among their prefixes, the first n - ceil(0.75 n) + 1 words; within the lines of such a word the length filter,
the positional filter and a parity bitmap of each set (which bounds from below in how many words two sets
differ) leave the candidates. A word that more than HOT lines hold stands together with a later word of the
prefix, one place longer, since the sets share two words there.

Candidates are never listed pair by pair: each task tells only which classes hang together, and the classes that
do so over all tasks, as far as their number goes beyond BLOCK in blocks, meet once with their whole sets. There all
pairs that pass the same filters are verified, and each class gets its number of matches and the earliest of them.

A line is removed if an earlier line (by doc_id, then line number) matches it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LARGE, components, forget, marked_by, pick, sieved, texts_of, written
from .words import buffers, mixed, words_of

NUMERATOR = 75
BUCKETS, PARTS = 1 << 21, 64
HOT = 20_000
LONG, WIDEST = 56, 8
#: The largest size and place that a row tells; larger ones count as these, which lets more candidates through.
SIZE, PLACE = (1 << 24) - 1, (1 << 15) - 1
#: Classes of a group that meet with as many others at once.
BLOCK = 4096
#: Words of the classes of a group that meet with as many others at once.
WORDS = 1 << 20
#: Rows of one prefix key that one task compares with each other; those of keys with more are dealt anew in blocks of as many.
HEAVY = 16_000
#: Pairs (or words of them) that are looked at together, rows of prefixes, and words of sets.
CHUNK, ROWS, SETS = 1 << 18, 200_000, 1 << 20
LINES = "doc_id long, line int, class long, check long, n int, counts binary"


class Lines(NamedTuple):
    """Lines that have words: the row of each one's text and its number in it, its class, n, and its distinct words' hashes one after another."""

    row: np.ndarray
    line: np.ndarray
    of: np.ndarray
    check: np.ndarray
    n: np.ndarray
    words: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n

    def only(self, keep: np.ndarray) -> Lines:
        return Lines(*(x[keep] for x in self[:5]), self.words[np.repeat(keep, self.n)])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Lines]]:
    """The lines of batches (doc_id, text as UTF-8), with the doc_ids that their rows are of."""
    for batch in batches:
        for low, texts in buffers([t or b"" for t in batch.column("text").to_pylist()]):
            w = words_of(texts)
            if not len(w.hashes):
                continue
            # by line, then by hash; the bits that the line's number leaves tell words of one line apart
            room = np.uint64(64 - max(20, int(w.line[-1]).bit_length()))
            order = np.argsort(w.line.astype(np.uint64) << room | w.hashes >> np.uint64(64) - room)
            h, line = w.hashes[order], w.line[order]
            keep = np.r_[True, (h[1:] != h[:-1]) | (line[1:] != line[:-1])]
            text, h, line = w.text[order][keep], h[keep], line[keep]
            starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            n = np.diff(np.r_[starts, len(line)])
            # a set's 112 bits: two sums of its words', mixed; the class has 48 of them, since it stands in many rows
            of, check = (mixed(np.add.reduceat(mixed(h ^ np.uint64(k)), starts) + n.astype(np.uint64)) for k in (0, 0x5BD1E995))
            of, check = (of >> np.uint64(16)).view(np.int64), check.view(np.int64)
            text = text[starts]
            yield batch.column("doc_id").slice(low, len(texts)), Lines(text, line[starts] - w.first_line[text], of, check, n, h)


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(43)).astype(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line, and at the end PARTS with the counts of the buckets."""
    kinds = [(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in LINES.split(", ")]
    row = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, kind) if c is not None else pa.nulls(len(columns[1]), kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[k for k, _ in kinds])
    counts = np.zeros(BUCKETS, dtype=np.uint32)
    for ids, part in _tokens(batches):
        np.add.at(counts, _bucket(part.words), np.uint32(1))
        yield row(ids.take(pa.array(part.row)), part.line.astype(np.int32), part.of, part.check, part.n.astype(np.int32), None)
    if counts.any():
        blobs = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(PARTS, -1)]
        yield row(np.arange(PARTS), np.zeros(PARTS, np.int32), None, None, None, blobs)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of counts by part, of which there are few."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("doc_id").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            new = np.frombuffer(zlib.decompress(blob), dtype=np.uint32).astype(np.uint64)
            sums[k] = sums[k] + new if k in sums else new
    yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int64()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], names=["doc_id", "counts"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[Lines]:
    """The first line of each class, as far as this task remembers those it has had."""
    done: set[int] = set()
    for _, part in _tokens(batches):
        # a task has so many classes that 48 bits wouldn't tell them apart
        of, first = np.unique(part.of.view(np.uint64) | part.check.view(np.uint64) << np.uint64(48), return_index=True)
        new = np.array([c not in done for c in of.tolist()], dtype=bool)
        keep = np.zeros(len(part.n), dtype=bool)
        keep[first[new]] = True
        done.update(of[new].tolist())
        if keep.any():
            yield part.only(keep)
        if len(done) > 500_000:
            done.clear()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _once(batches):
        offsets = pa.array(np.r_[part.starts, len(part.words)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(part.of), pa.array(part.check), pa.ListArray.from_arrays(offsets, pa.array(part.words.view(np.int64)))], names=["id", "check", "words"])


def _need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least overlap of matching sets of n and m words."""
    return -(-NUMERATOR * (n + m) // (100 + NUMERATOR))


class Bitmaps(NamedTuple):
    """A parity bitmap of each row's set, whose words turn over one bit each; longer sets have more bits, up to WIDEST times 64.

    A bitmap of one width becomes that of half the width by laying its halves upon each other, so that any two can be compared.
    """

    width: np.ndarray
    folded: np.ndarray
    #: The whole bitmaps of those wider than 64 bits, filled up with zeros, and where each row's is among them.
    slot: np.ndarray
    wide: np.ndarray

    @staticmethod
    def laid(width: np.ndarray, flat: np.ndarray) -> Bitmaps:
        """From the widths and the bitmaps one after another."""
        starts = np.cumsum(width) - width
        long = width > 1
        slot, own = np.cumsum(long) - 1, np.repeat(long, width)
        wide = np.zeros((int(long.sum()), WIDEST), dtype=np.uint64)
        wide[np.repeat(slot, width)[own], (np.arange(len(flat)) - np.repeat(starts, width))[own]] = flat[own]
        return Bitmaps(width, np.bitwise_xor.reduceat(flat, starts), slot, wide)

    def only(self, rows: np.ndarray) -> Bitmaps:
        """Those of rows, by number or mask."""
        return Bitmaps(self.width[rows], self.folded[rows], self.slot[rows], self.wide)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many words, at least, the sets of two wide rows differ; 0 if one isn't wide."""
        width, found = np.minimum(self.width[i], self.width[j]), np.zeros(len(i), dtype=np.int64)
        for k in (2 << x for x in range(WIDEST.bit_length() - 1)):
            at = np.flatnonzero(width == k)
            if len(at):
                a, b = (np.bitwise_xor.reduce(self.wide[self.slot[rows[at]]].reshape(-1, WIDEST // k, k), axis=1) for rows in (i, j))
                found[at] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return found


def _bits(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The widths of the sets' bitmaps, in 64 bits, and the bitmaps one after another."""
    width = np.ones(len(n), dtype=np.int64)
    for k in range(WIDEST.bit_length() - 1):
        width[n > LONG << k] = 2 << k
    part = (words >> np.uint64(34)).astype(np.int64) & np.repeat(width - 1, n)
    at = (np.repeat(np.cumsum(width) - width, n) + part) << 6 | ((words >> np.uint64(37)).astype(np.int64) & 63)
    odd = (np.bincount(at, minlength=64 * int(width.sum())) & 1).astype(np.uint8)
    return width, np.packbits(odd, bitorder="little").view(np.uint64)


def _prefixes(rarity: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _once(batches):
            part = part.only(part.n > 2)  # smaller sets match equal ones only
            if not len(part.n):
                continue
            words, n, starts = part.words, part.n, part.starts
            (width, flat), count = _bits(words, n), rarity[_bucket(words)]
            ends = np.r_[0, np.cumsum(8 * width)].astype(np.int32)
            bits = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            row = np.repeat(np.arange(len(n)), n)
            order = np.argsort(row << 32 | count, kind="stable")  # equal counts stay in the order of their hashes
            words, count = words[order], count[order]
            place = np.arange(len(words)) - starts[row]
            size = (n - -(-NUMERATOR * n // 100) + 1)[row]
            # a word that all lines together hold once has no other line
            single = np.flatnonzero((place < size) & (count > 1) & (count <= HOT))
            hot = np.flatnonzero((place < size) & (count > HOT))
            later = size[hot] - place[hot]  # words after it in the prefix that is one longer
            first = np.repeat(hot, later)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
            # 40 bits of a key: words that share them meet to no end, and rows are shorter
            key = np.r_[words[single], mixed(words[first] ^ mixed(words[second]))] >> np.uint64(24) << np.uint64(24)
            at = np.r_[single, first]
            row = row[at]
            key = key.view(np.int64) | np.minimum(n[row], SIZE)
            ref = np.minimum(place[at], PLACE) << 48 | part.of[row]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ref), bits.take(pa.array(row))], names=["key", "ref", "bits"])

    return run


def _pairs(key: np.ndarray, n: np.ndarray, bits: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows sorted by key, then n, that have one key and pass the length filter and the bitmaps; CHUNK at once."""
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]]) << 32
    more = np.searchsorted(group + n, group + n * 100 // NUMERATOR, side="right") - np.arange(len(key)) - 1
    upto, low = np.cumsum(more), 0
    while low < len(key):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + CHUNK, side="right")))
        c = more[low:high]
        i = np.repeat(np.arange(low, high), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        low = high
        both = n[i] + n[j]
        room = both - 2 * _need(both, 0)
        ok = np.bitwise_count(bits.folded[i] ^ bits.folded[j]) <= room
        i, j, room = i[ok], j[ok], room[ok]
        ok = bits.apart(i, j) <= room
        yield i[ok], j[ok]


def _hanging(key: np.ndarray, ref: np.ndarray, bits: Bitmaps, unit: np.ndarray | None = None, side: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(a, b) of classes, enough to hold together those that candidate pairs connect; of units only pairs between sides (2 is both)."""
    n, place, of = key & SIZE, ref >> 48, ref & ((1 << 48) - 1)
    for i, j in _pairs(key >> 24 if unit is None else unit, n, bits):
        if side is not None:
            ok = (side[i] != side[j]) | (side[i] == 2)
            i, j = i[ok], j[ok]
        room = 1 + np.minimum(n[i] - place[i] - 1, n[j] - place[j] - 1)  # the positional filter
        ok = (room >= _need(n[i], n[j])) & (of[i] != of[j])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        rows, ends = np.unique(np.r_[i, j], return_inverse=True)
        i, j = ends[: len(i)], ends[len(i) :]
        low = np.arange(len(rows))
        while True:  # the least row that each one's pairs lead to
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            new = new[new]
            if (new == low).all():
                break
            low = new
        a, b = of[rows], of[rows[low]]
        both = np.unique(np.column_stack([a, b])[a != b], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in both.T], names=["a", "b"])


def _grouped(batches: Iterator[pa.RecordBatch], key: str, most: int, shift: int = 0, weight: str | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Rows that come sorted by a key (without its last bits), in tables of most rows (or of a weight of most) or more.

    No table cuts the rows of one key, but for keys of a shift that go beyond one table: those come as they are, told by True.
    """
    held, size, long = [], 0, None

    def cut_at_last(whole: pa.Table) -> int:
        keys = whole.column(key).to_numpy() >> shift
        return int(np.searchsorted(keys, keys[-1]))

    for batch in batches:
        if not batch.num_rows:
            continue
        if long is not None:  # what still belongs to it passes by
            keys = batch.column(key).to_numpy() >> shift
            end = int(np.searchsorted(keys, long, side="right"))
            if end:
                yield pa.Table.from_batches([batch.slice(0, end)]), True
            if end == batch.num_rows:
                continue
            long, batch = None, batch.slice(end)
        held.append(batch)
        size += int(batch.column(weight).to_numpy().sum()) if weight else batch.num_rows
        if size >= most:
            whole = pa.Table.from_batches(held)
            cut = cut_at_last(whole)  # the last key may go on
            if cut:
                yield whole.slice(0, cut), False
                whole = whole.slice(cut)
            elif shift:
                yield whole, True
                long, whole = int(whole.column(key)[0].as_py()) >> shift, whole.slice(0, 0)
            held = whole.to_batches()
            size = (int(whole.column(weight).to_numpy().sum()) if weight else whole.num_rows) if cut else 0  # a long key is looked at again after as many rows
    if held:
        yield pa.Table.from_batches(held), False


def _bitmaps(bits: pa.Array) -> Bitmaps:
    width = pc.binary_length(bits).to_numpy().astype(np.int64) >> 3
    return Bitmaps.laid(width, np.frombuffer(bits.buffers()[2], dtype=np.uint64, count=int(width.sum())))


def _candidates(most: int):
    """(a, b, key, ref, bits): what hangs together in the rows of each key, and the rows themselves of keys that have more than most.

    Rows come sorted by key and size, then place and class.
    """

    def told(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = lambda c, kind: rows.column(c) if c in rows.schema.names else pa.nulls(rows.num_rows, kind)
        kinds = {"a": pa.int64(), "b": pa.int64(), "key": pa.int64(), "ref": pa.int64(), "bits": pa.binary()}
        return pa.RecordBatch.from_arrays([none(c, k) for c, k in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, more in _grouped(batches, "key", ROWS, 24):
            key, ref = some.column("key").to_numpy(), some.column("ref").to_numpy()
            new = np.r_[True, (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])]  # repeats of a class by other tasks go
            some, key, ref = some.filter(pa.array(new)), key[new], ref[new]
            _, of, n = np.unique(key >> 24, return_inverse=True, return_counts=True)
            heavy = (n > most)[of] | more
            if heavy.any():
                yield from map(told, some.filter(pa.array(heavy)).combine_chunks().to_batches(max_chunksize=ROWS))
            if not heavy.all():
                bits = some.column("bits").filter(pa.array(~heavy)).combine_chunks()  # a new array, whose buffer begins with its first value
                yield from map(told, _hanging(key[~heavy], ref[~heavy], _bitmaps(bits)))

    return run


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What hangs together between the two sides of each unit of rows of one key, which come sorted by unit and size."""
    for some, _ in _grouped(batches, "unit", 2 * HEAVY):
        bits = some.column("bits").filter(pa.array(np.ones(some.num_rows, dtype=bool))).combine_chunks()
        unit, key, ref, side = (some.column(c).to_numpy() for c in ("unit", "key", "ref", "side"))
        yield from _hanging(key, ref, _bitmaps(bits), unit, side)


def _heavy(rows: DataFrame) -> DataFrame:
    """(a, b) of what hangs together among rows (key, ref, bits) of keys with many: each key's are dealt in blocks that meet two by two."""
    part = F.shiftright("key", 24)
    counts = rows.groupBy(part.alias("_of")).agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("blocks"))
    rows = rows.join(counts, part == F.col("_of")).withColumn("own", F.pmod(F.xxhash64("ref", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    rows = rows.select(F.xxhash64("_of", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "key", "ref", "bits", side.alias("side"))
    return rows.repartition("unit").sortWithinPartitions("unit", "key", "ref").mapInArrow(_in_blocks, "a long, b long").distinct()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, check, links, doc_id, line): for each class of a unit its matches there, and the earliest of them. Rows come sorted by unit, then n."""
    for some, _ in _grouped(batches, "unit", SETS, weight="n"):
        unit, n, side, of, check, doc_id, line = (some.column(c).to_numpy() for c in ("unit", "n", "side", "class", "check", "doc_id", "line"))
        lists = some.column("words").combine_chunks()
        words = lists.flatten().to_numpy().view(np.uint64)
        n, starts = n.astype(np.int64), np.cumsum(n) - n
        # each row's words by small numbers, in order, under the row's number
        _, small, count = np.unique(words, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(n)), n)
        inside = np.sort(row << 32 | small)
        links, early = np.zeros(len(n), dtype=np.int64), np.full(len(n), len(n))
        order = np.lexsort((line, doc_id))
        rank = np.empty(len(n), dtype=np.int64)
        rank[order] = np.arange(len(n))
        # the prefixes again, by rarity among these rows
        small = inside & 0xFFFFFFFF
        small = small[np.argsort(row << 32 | count[small], kind="stable")]
        place = np.arange(len(small)) - starts[row]
        keep = (place < (n - -(-NUMERATOR * n // 100) + 1)[row]) & (count[small] > 1)
        own, place, key = row[keep], place[keep], np.cumsum(np.r_[0, unit[1:] != unit[:-1]])[row[keep]] << 32 | small[keep]
        sort = np.lexsort((n[own], key))
        own, place, key = own[sort], place[sort], key[sort]
        bits = Bitmaps.laid(*_bits(words, n)).only(own)
        found = [np.empty(0, dtype=np.int64)]
        for i, j in _pairs(key, n[own], bits):
            a, b = own[i], own[j]
            ok = (side[a] != side[b]) | (side[a] == 2)
            ok &= 1 + np.minimum(n[a] - place[i] - 1, n[b] - place[j] - 1) >= _need(n[a], n[b])
            found.append(np.unique(np.minimum(a[ok], b[ok]) << 32 | np.maximum(a[ok], b[ok])))
        found = np.unique(np.concatenate(found))
        i, j = found >> 32, found & 0xFFFFFFFF
        upto, low = np.cumsum(n[i]), 0
        while low < len(i):  # some CHUNK words at once
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + CHUNK, side="right")))
            a, b = i[low:high], j[low:high]
            low, c = high, n[a]
            at = np.arange(c.sum()) + np.repeat(starts[a] - np.cumsum(c) + c, c)
            wanted = np.repeat(b, c) << 32 | (inside[at] & 0xFFFFFFFF)
            where = np.minimum(np.searchsorted(inside, wanted), len(inside) - 1)
            both = np.add.reduceat(inside[where] == wanted, np.cumsum(c) - c, dtype=np.int64)
            ok = 100 * both >= NUMERATOR * (n[a] + n[b] - both)
            a, b = a[ok], b[ok]
            links += np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n))
            np.minimum.at(early, a, rank[b])
            np.minimum.at(early, b, rank[a])
        has = np.flatnonzero(links)
        first = order[early[has]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of[has], check[has], links[has], doc_id[first], line[first])], names=["class", "check", "links", "doc_id", "line"])


def matched(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines (doc_id, line, class, check, n); the first line of each class and how many there are; and, of classes with matches, (class, check, links, other): all written."""
    found = texts_of(docs).filter("doc_id IS NOT NULL")
    both = written(found.mapInArrow(_lines, LINES), "lines")
    lines = both.filter("counts IS NULL").drop("counts")
    rarity = np.zeros(BUCKETS, dtype=np.uint32)
    sums = both.filter("counts IS NOT NULL").select("doc_id", "counts").repartition(PARTS, "doc_id").mapInArrow(_summed, "doc_id long, counts binary")
    for r in sums.collect():  # PARTS rows, BUCKETS counts
        rarity.reshape(PARTS, -1)[r["doc_id"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    firsts = lines.groupBy("class", "check").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("times"), F.max("n").alias("size"))
    firsts = written(firsts, "line-classes")

    prefixes = found.mapInArrow(_prefixes(rarity), "key long, ref long, bits binary")
    dealt = prefixes.repartition(F.shiftright("key", 24)).sortWithinPartitions("key", "ref")
    found_once = written(dealt.mapInArrow(_candidates(HEAVY), "a long, b long, key long, ref long, bits binary").distinct(), "line-candidates", LARGE)
    hanging, heavy = found_once.filter("a IS NOT NULL").select("a", "b"), found_once.filter("key IS NOT NULL").select("key", "ref", "bits")
    if not heavy.isEmpty():
        hanging = hanging.unionByName(written(_heavy(heavy), "line-blocks", LARGE))
    groups = components(hanging)
    # what is to be known of the classes of groups, without their sets: those travel twice only
    inside = sieved(firsts.withColumnRenamed("class", "id"), groups.select("id")).join(groups, "id").withColumnRenamed("id", "class")
    inside = written(inside.select("class", "check", "component", "first.doc_id", "first.line", "size"), "line-groups")
    sizes = inside.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / WORDS)).cast("int").alias("blocks"))
    known = inside.drop("size").join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("class", "check"), F.col("blocks")).cast("int"))
    # only texts that may hold the first line of such a class are read once more
    holding = sieved(found.withColumnRenamed("doc_id", "id"), inside.select(F.col("doc_id").alias("id")).distinct()).withColumnRenamed("id", "doc_id")
    sets = sieved(holding.mapInArrow(_sets, "id long, check long, words array<long>"), groups.select("id")).withColumnRenamed("id", "class")
    units = sets.join(known, ["class", "check"]).dropDuplicates(["class", "check"])
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("n", F.size("words"))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    units = units.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "n", side.alias("side"), "class", "check", "doc_id", "line", "words")
    told = units.repartition("unit").sortWithinPartitions("unit", "n").mapInArrow(_verified, "class long, check long, links long, doc_id long, line int")
    links = told.groupBy("class", "check").agg(F.sum("links").alias("links"), F.min(F.struct("doc_id", "line")).alias("other"))
    links = written(links, "line-links")
    for old in (found_once, inside, groups):
        forget(old)
    return lines, firsts, links


def decided(docs: DataFrame) -> DataFrame:
    """(doc_id, line, links, removed) of each line that has words.

    Only lines of classes that repeat or have matches are to be removed or to count; the others needn't travel.
    """
    lines, firsts, links = matched(docs)
    early = firsts.filter("times > 1").select("class", "check", F.lit(0).cast("long").alias("links"), F.col("first").alias("early"))
    early = early.unionByName(links.withColumnRenamed("other", "early")).groupBy("class", "check").agg(F.sum("links").alias("links"), F.min("early").alias("early"))
    early = written(early, "line-early")
    marked = marked_by(lines, F.col("class"), early.select(F.col("class").alias("id")))
    told = marked.filter("_may").join(early, ["class", "check"], "left")
    removed = F.coalesce(F.struct("doc_id", "line") > F.col("early"), F.lit(False))
    told = told.select("doc_id", "line", F.coalesce("links", F.lit(0)).cast("long").alias("links"), removed.alias("removed"))
    rest = marked.filter("NOT _may").select("doc_id", "line", F.lit(0).cast("long").alias("links"), F.lit(False).alias("removed"))
    return told.unionByName(rest)


def _told(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, gone) of the documents with lines, written: gone are the numbers of the lines that go."""
    gone = F.collect_list(F.when(F.col("removed"), F.col("line"))).alias("gone")
    sums = decided(docs).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"), F.sum("links").alias("n_links"), gone)
    return written(sums.withColumnRenamed("doc_id", "_id"), "line-counts", LARGE)


def _left(text: Column) -> Column:
    """A text without its gone lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, text_sha256) of each row of docs; text_sha256 is that of the text without its removed lines.

    n_lines counts lines with words; n_links sums, over them, the classes of other texts they match.
    Null texts have no lines and count as empty; rows without a doc_id are returned with zeros and their text as it is. Repeated doc_ids
    count as one document's lines. Only texts that may lose lines travel, the others' digests do.
    """
    sums = _told(docs)
    rows = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = marked_by(rows, F.col("doc_id"), sums.filter("n_removed > 0").select(F.col("_id").alias("id")))
    rows = rows.select("doc_id", F.when(~F.col("_may"), F.sha2("text", 256)).alias("sha"), F.when(F.col("_may"), F.col("text")).alias("text"))
    found = rows.join(sums, F.col("doc_id") == F.col("_id"), "left")
    text = F.when(F.col("n_removed") > 0, _left(F.col("text"))).otherwise(F.col("text"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_removed", "n_links")]
    return found.select("doc_id", *counts, F.coalesce("sha", F.sha2(text, 256)).alias("text_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of each row of docs without its removed lines.

    Null texts stay null, rows without a doc_id stay as they are; an empty table stays empty. Only texts that may lose lines travel.
    """
    gone = _told(docs).filter("n_removed > 0").select("_id", "gone")
    rows = marked_by(pick(docs, doc_id="long", text="string"), F.col("doc_id"), gone.select(F.col("_id").alias("id")))
    some = rows.filter("_may").join(gone, F.col("doc_id") == F.col("_id"), "left")
    some = some.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_left(F.col("text"))).alias("text"))
    return rows.filter("NOT _may").select("doc_id", "text").unionByName(some)
