"""MinHash near-dedup by an LSH forest.

A document is the set of its distinct five-word shingles. Documents with equal sets are one class
from the start. Each class has a signature of minimum hashes; the forest is TREES sorted orders
of the classes, each by its own rotation of the signature. Neighbours in an order that share at
least DEPTH leading hashes are candidates:

* where few classes share them, all their pairs within that run are (a run of n <= RUN classes);
* in a denser region the depth adapts: a class is compared with the next classes of the order,
  which share the longest prefixes with it, and with the run's hub, the class whose signature is
  nearest to the most common value at each position. Components are what is asked for, so
  a dense group first gets links enough to hang together;
* then all pairs of each dense run whose ends are still in different components are compared, in
  blocks dealt over tasks, and so are those of runs that a border between sorted partitions divides.

Pairs whose signatures agree on too few places to be similar (below MIN_AGREE, 4.4 standard
deviations under what a similarity of 0.75 gives) are left out, and so are pairs of sets of too different sizes. The rest are confirmed on full sets,
in two rounds: first each class with its best candidate, then, of the other candidates, only
those between different components of the first round; then the pairs of dense runs, inside the tasks in which they
meet. The links' components are the groups.

At a similarity of exactly 0.75 a pair shares no prefix of DEPTH in any of the TREES orders with
probability (1 - 0.75 ** 3) ** 20 = 2e-5, however many others share it.

No stage groups rows by a key that could be hot: orders are range partitioned on whole labels,
so that a group of near copies spreads over partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE, components, forget, hidden, marked_by, pick, shown, sieved, texts_of, without, written
from .words import buffers, mixed, words_of

WORDS = 5
NUMERATOR = 75  # of a hundredth: 100 * intersection >= 75 * union
TREES, DEPTH = 20, 3
HASHES = TREES * DEPTH
RUN, NEXT = 24, 4
MIN_AGREE = 30
ROWS_A_TASK = 20_000
LABEL = 8 + HASHES + 4  # bytes of a label
#: Classes of a dense run that are compared with as many others at once, by signatures and by texts; shingles that a task keeps.
BLOCK, SET_BLOCK, SETS_HELD = 4096, 512, 4_000_000


@lru_cache(maxsize=1)
def _numbers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; fewer words than a shingle's are one."""
    words = words_of(texts)
    h, n = words.hashes, np.bincount(words.text, minlength=len(texts))
    ends = np.cumsum(n)
    out = np.zeros(max(0, len(h) - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        out = mixed(out ^ h[k : k + len(out)]) + np.uint64(k)
    found = []
    for size, end in zip(n.tolist(), ends.tolist(), strict=True):
        if size >= WORDS:
            one = np.sort(out[end - size : end - WORDS + 1])
            found.append(one[np.r_[True, one[1:] != one[:-1]]])
        elif size:
            one = np.zeros(1, dtype=np.uint64)
            for k in range(WORDS):
                one = mixed(one ^ (h[end - size + k] if k < size else np.uint64(size))) + np.uint64(k)
            found.append(one)
        else:
            found.append(np.empty(0, dtype=np.uint64))
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minimum hashes of 32 bits of each set; none of them is empty."""
    a, b = _numbers()
    whole, starts = np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets[:-1]])
    low = np.empty((len(sets), HASHES), dtype=np.uint64)
    for k in range(HASHES):
        low[:, k] = np.minimum.reduceat(whole * a[k] + b[k], starts)
    return (mixed(low) >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_digest, signature) of each row; an empty set has no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, digest, sig = [t or b"" for t in batch.column("text").to_pylist()], [], [], []
            for _, part in buffers(texts):
                sets = shingle_sets(part)
                full = [x for x in sets if len(x)]
                minima = iter(signatures(full)) if full else iter(())
                n += map(len, sets)
                digest += [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                sig += [next(minima).tobytes() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_digest", "signature"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, signature binary")


def _keys_of(sig: np.ndarray, tree: int) -> np.ndarray:
    """The hash of the first hashes in a tree's order."""
    key = np.full(len(sig), tree, dtype=np.uint64)
    for k in range(DEPTH):
        key = mixed(key ^ sig[:, tree * DEPTH + k].astype(np.uint64)) + np.uint64(tree)
    return key


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the hash of its first hashes, then a byte of each further hash in its order, then the set's size."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sig = _signatures(part)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            small = (sig & np.uint32(0xFF)).astype(np.uint8)
            size = part.column("n").to_numpy().astype(np.uint32).view(np.uint8).reshape(-1, 4)
            labels = []
            for tree in range(TREES):
                key = _keys_of(sig, tree)
                rolled = np.roll(small, -tree * DEPTH, axis=1)
                labels.append(np.hstack([key.astype(">u8").view(np.uint8).reshape(-1, 8), rolled, size]))
            whole = np.concatenate(labels)
            flat = pa.py_buffer(np.ascontiguousarray(whole).tobytes())
            offsets = pa.py_buffer((np.arange(len(whole) + 1, dtype=np.int32) * whole.shape[1]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(whole), [None, offsets, flat]), pa.array(np.tile(ids, TREES), type=pa.int64())], names=["label", "id"])


def _may(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles may be similar, by the places on which their signatures agree and by their sizes."""
    return (agree >= MIN_AGREE) & (100 * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m))


def _pairs_of_run(labels: np.ndarray, ids: np.ndarray, out: dict[tuple[int, int], int]) -> None:
    """Adds a run's candidate pairs, with the places on which their signatures agree."""
    m, size = labels[:, 8:-4], np.ascontiguousarray(labels[:, -4:]).view(np.uint32).ravel().astype(np.int64)
    n = len(ids)
    reach = n - 1 if n <= RUN else NEXT
    found = []
    for step in range(1, reach + 1):
        agree = (m[:-step] == m[step:]).sum(axis=1)
        for i in np.flatnonzero(_may(agree, size[:-step], size[step:])):
            found.append((ids[i], ids[i + step], agree[i]))
    if n > RUN:
        common = np.array([np.bincount(m[:, k], minlength=256).argmax() for k in range(m.shape[1])], dtype=np.uint8)
        hub = int((m == common).sum(axis=1).argmax())
        agree = (m == m[hub]).sum(axis=1)
        found += [(ids[i], ids[hub], agree[i]) for i in np.flatnonzero(_may(agree, size, size[hub])) if i != hub]
    for a, b, k in found:
        a, b = (int(a), int(b)) if a < b else (int(b), int(a))
        if a != b:
            out[a, b] = int(k)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of one sorted partition: runs of equal first hashes, whole but at its borders.

    Runs that are not compared whole, as they are dense or at a border, are told by rows (key, null, size).
    """
    held = (np.empty((0, LABEL), dtype=np.uint8), np.empty(0, dtype=np.int64))
    out: dict[tuple[int, int], int] = {}
    told: dict[int, int] = {}
    edge: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        a, b = zip(*out, strict=True) if out else ((), ())
        batch = pa.RecordBatch.from_arrays([pa.array([*a, *told], pa.int64()), pa.array([*b, *[None] * len(told)], pa.int64()), pa.array([*out.values(), *told.values()], pa.int32())], names=["a", "b", "agree"])
        out.clear()
        told.clear()
        return batch

    def take(rows: np.ndarray, ids: np.ndarray) -> None:
        key = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel()
        number = key.astype(np.uint64).view(np.int64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        told.update((int(number[s]), int(e - s)) for s, e in zip(starts[ends - starts > RUN], ends[ends - starts > RUN], strict=True))
        if not edge:
            edge.append((int(number[0]), int(ends[0])))
            told[edge[0][0]] = edge[0][1]
        edge[1:] = [(int(number[-1]), int(len(key) - starts[-1]))]
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            _pairs_of_run(rows[s:e], ids[s:e], out)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.frombuffer(b"".join(batch.column("label").to_pylist()), dtype=np.uint8).reshape(-1, LABEL)
        held = (np.concatenate([held[0], rows]), np.concatenate([held[1], batch.column("id").to_numpy(zero_copy_only=False)]))
        # the last run may go on in the next batch; a very long one is taken in parts that overlap
        same = (held[0][:, :8] == held[0][-1, :8]).all(axis=1)
        cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if len(held[1]) - cut > ROWS_A_TASK:
            take(*held)
            cut = len(held[1]) - NEXT
        elif cut:
            take(held[0][:cut], held[1][:cut])
        held = (held[0][cut:], held[1][cut:])
        if len(out) > 200_000:
            yield flush()
    if len(held[1]):
        take(*held)
    told.update(edge[1:])
    yield flush()


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, agree) of classes (id, n, signature), a < b, each pair once; and (key, null, size) of runs that are not compared whole."""
    # a stated number of partitions: the labels' bytes are known beforehand
    parts = max(8, classes.count() * TREES // ROWS_A_TASK)
    labels = classes.mapInArrow(_labels, "label binary, id long").repartitionByRange(parts, "label").sortWithinPartitions("label", "id")
    return labels.mapInArrow(_candidates, "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"), F.sum("agree").alias("size"), F.count("*").alias("parts"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, class): the key of each class in each tree."""
    for batch in batches:
        sig, ids = _signatures(batch), batch.column("id").to_numpy(zero_copy_only=False)
        keys = np.concatenate([_keys_of(sig, tree) for tree in range(TREES)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(ids, TREES), type=pa.int64())], names=["id", "class"])


def _comparable(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a unit's rows that are of two sides or of side 2, in different components, and may be similar."""
    side, part, size = (rows.column(c).to_numpy() for c in ("side", "component", "n"))
    m = (np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, HASHES) & np.uint32(0xFF)).astype(np.uint8)
    within = bool((side == 2).all())
    left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    left, right = left[np.argsort(part[left], kind="stable")], right[np.argsort(part[right], kind="stable")]
    columns, right_part, right_size = np.ascontiguousarray(m[right].T), part[right], size[right]
    for i in left:
        low, high = np.searchsorted(right_part, part[i], "left"), np.searchsorted(right_part, part[i], "right")
        for s, e in ((high, len(right)),) if within else ((0, low), (high, len(right))):
            if s < e:
                found = (columns[:, s:e] == m[i][:, None]).sum(axis=0, dtype=np.uint8)
                at = right[s + np.flatnonzero(_may(found, size[i], right_size[s:e]))]
                if len(at):
                    yield np.full(len(at), i), at


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit; they come sorted by unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            unit = batch.column("unit").to_numpy()
            if held and held[0].column("unit")[0].as_py() != unit[0]:
                yield pa.Table.from_batches(held)
                held = []
            end = int(np.searchsorted(unit, unit[0], "right"))
            held.append(batch.slice(0, end))
            batch = batch.slice(end)
    if held:
        yield pa.Table.from_batches(held)


def _root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = i = up[up[i]]
    return i


def _told(rows: pa.Table, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ids = rows.column("class").to_numpy()
    a, b = (ids[[p[k] for p in pairs]] if pairs else np.empty(0, dtype=np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _hanging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a unit's comparable pairs, enough to hold together what they connect."""
    for rows in _units(batches):
        up, kept = list(range(rows.num_rows)), []
        for left, right in _comparable(rows):
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                x, y = _root(up, i), _root(up, j)
                if x != y:
                    up[x] = y
                    kept.append((i, j))
        yield _told(rows, kept)


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a unit's comparable pairs, the confirmed ones, as far as they join components that others don't."""
    for rows in _units(batches):
        parts = {p: k for k, p in enumerate(dict.fromkeys(rows.column("component").to_pylist()))}
        of, packed = [parts[p] for p in rows.column("component").to_pylist()], rows.column("packed").to_pylist()
        up, kept, sets, held = list(range(len(parts))), [], {}, 0
        for left, right in _comparable(rows):
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                x, y = _root(up, of[i]), _root(up, of[j])
                if x == y:
                    continue
                if held > SETS_HELD:
                    sets, held = {}, 0
                for k in (i, j):
                    if k not in sets:
                        (sets[k],) = shingle_sets([zlib.decompress(packed[k])])
                        held += len(sets[k])
                if _similar(sets[i], sets[j]):
                    up[x] = y
                    kept.append((i, j))
        yield _told(rows, kept)


def crowded(docs: DataFrame, classes: DataFrame, keys: DataFrame, parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different components of parts (id, component) among the classes that share a run of keys (id), written.

    All pairs of a run are compared on their signatures, but no pair is listed: tasks tell what hangs together, and
    what does meets once more with its texts, in blocks, to be confirmed on full sets.
    """
    inside = sieved(classes.select("id", "signature").mapInArrow(_keys, "id long, class long"), keys).join(keys, "id", "left_semi")
    inside = inside.join(parts.select(F.col("id").alias("class"), "component"), "class", "left").select("id", "class", F.coalesce("component", "class").alias("component"))
    inside = written(inside, "crowded")
    runs = inside.groupBy("id").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    dealt = _in_blocks(inside.join(runs.select("id", F.col("n").alias("size")), "id"), block)
    dealt = dealt.join(classes.select(F.col("id").alias("class"), "n", "signature"), "class").select("unit", "side", "class", "component", "n", "signature")
    found = written(dealt.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_hanging, "a long, b long").distinct(), "hanging", 10_000)
    groups = components(found)
    ends = groups.select("id")
    texts = sieved(texts_of(docs).withColumnRenamed("doc_id", "id"), ends).mapInArrow(_packed, "id long, packed binary").join(ends, "id", "left_semi").dropDuplicates(["id"])
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "component").select(F.col("id").alias("class"), F.col("component").alias("id"), "size")
    members = members.join(parts.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    members = members.join(classes.select(F.col("id").alias("class"), "n", "signature"), "class").join(texts.withColumnRenamed("id", "class"), "class")
    dealt = _in_blocks(members, SET_BLOCK).select("unit", "side", "class", "component", "n", "signature", "packed")
    links = written(dealt.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_joining, "a long, b long"), "links")
    for old in (inside, found, groups):
        forget(old)
    return links


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows (id, class, size, any others) with (unit, side): of a group id of more than block classes, blocks meet each other two by two."""
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    return rows.withColumn("side", side).withColumn("unit", F.xxhash64("id", F.least("own", "other"), F.greatest("own", "other")))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= NUMERATOR * (len(x) + len(y) - both)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed: they take a fifth of the bytes that their shingles' hashes would."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([zlib.compress(t or b"", 4) for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "packed"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full sets, from the texts (id, packed), are similar."""

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for low in range(0, len(left), 64):
            some = [[bytes(x) for x in side[low : low + 64]] for side in (left, right)]
            blobs = list(dict.fromkeys(some[0] + some[1]))
            texts, sets = [zlib.decompress(x) for x in blobs], []
            for _, part in buffers(texts):
                sets += shingle_sets(part)
            full = dict(zip(blobs, sets, strict=True))
            for x, y in zip(*some, strict=True):
                out.append(_similar(full[x], full[y]))
        return pd.Series(out, dtype="bool")

    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("left")), "a").join(texts.select(F.col("id").alias("b"), F.col("packed").alias("right")), "b")
    return joined.filter(similar("left", "right")).select("a", "b")


def _linked(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The confirmed links (a, b) of pairs (a, b, agree), as far as they join components; and (id, component)."""
    both = pairs.select("a", "b", "agree").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = written(both.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("back"))).alias("best")), "best")
    # every class with a candidate has one best one; texts of other classes are sieved out before they travel
    ends = best.select(F.col("a").alias("id"))
    texts = sieved(texts_of(docs).withColumnRenamed("doc_id", "id"), ends)
    packed = written(texts.mapInArrow(_packed, "id long, packed binary").join(ends, "id", "left_semi").dropDuplicates(["id"]), "texts")

    first = best.select(F.least("a", -F.col("best.back")).alias("x"), F.greatest("a", -F.col("best.back")).alias("y")).distinct().toDF("a", "b")
    links = written(confirmed(first, packed), "links")
    so_far = components(links)
    label = so_far.select("id", "component")
    rest = (
        pairs.join(label.toDF("a", "ca"), "a", "left")
        .join(label.toDF("b", "cb"), "b", "left")
        .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select("a", "b")
        .join(first, ["a", "b"], "left_anti")
    )
    rest = written(rest, "rest")
    some = rest.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    more = written(confirmed(rest, packed.join(some, "id", "left_semi")), "links")
    for old in (packed, rest, best):
        forget(old)
    links = links.unionByName(more)
    return links, components(links)


def apart(docs: DataFrame, twice: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) with _key: the doc_id, but of ids among twice (id) a number for each of their texts.

    Only rows whose id may be among twice travel; such numbers lie below all ids but the very least.
    """
    marked = marked_by(docs, F.col("doc_id"), twice)
    own = -F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)) - F.lit(1 << 62)
    hit = twice.select(F.col("id").alias("_twice"))
    found = marked.filter("_may").join(hit, F.col("doc_id") == F.col("_twice"), "left").withColumn("_key", F.when(F.col("_twice").isNotNull(), own).otherwise(F.col("doc_id"))).drop("_twice")
    return marked.filter("NOT _may").withColumn("_key", F.col("doc_id")).unionByName(found).drop("_may")


def _repeated(rows: DataFrame) -> DataFrame:
    """(id) of doc_ids that have several texts with different sets, written."""
    sets = rows.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("set_digest").alias("low"), F.max("set_digest").alias("high"), F.count("set_digest").alias("n"), F.count("*").alias("rows"))
    return written(sets.filter("low <> high OR n BETWEEN 1 AND rows - 1").select("id"), "repeated-ids", LARGE)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, n_shingles, component_id) of each row of docs with a doc_id, written; and the ids that apart() divides.

    Documents without words (or a null text) are alone. Rows of one doc_id are one document if their sets are equal, and else
    documents of their own that share the id; null doc_ids are alone and have a null component.
    """
    docs = pick(docs, doc_id="long", text="string")
    rows = written(signed(docs), "signatures")
    twice = _repeated(rows)
    if twice.isEmpty():
        return _groups(docs, rows).withColumn("key", F.col("doc_id")), twice
    forget(rows)
    docs = apart(docs, twice)
    names = written(docs.filter("_key <> doc_id").select(F.col("_key").alias("key"), F.col("doc_id").alias("own")).distinct(), "repeated-keys", LARGE)
    docs = docs.select(F.col("_key").alias("doc_id"), "text")
    found = _groups(docs, written(signed(docs), "signatures")).withColumnRenamed("doc_id", "key")
    found = found.join(names, "key", "left").withColumn("doc_id", F.coalesce("own", "key"))
    # a component with such a document is named by the least of its ids, not of its keys
    named = found.filter("own IS NOT NULL").select(F.col("component_id").alias("_of")).distinct()
    least = found.join(named, F.col("component_id") == F.col("_of")).groupBy("_of").agg(F.min("doc_id").alias("_least"))
    found = found.join(least, F.col("component_id") == F.col("_of"), "left").withColumn("component_id", F.coalesce("_least", "component_id"))
    return written(found.select("key", "doc_id", "n_shingles", "component_id"), "near-keys", LARGE), twice


def _groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents, whose ids tell their sets, and their signatures."""
    known = rows.filter("doc_id IS NOT NULL AND set_digest IS NOT NULL")
    firsts = known.groupBy("set_digest").agg(F.min("doc_id").alias("id"))
    classes = written(known.join(firsts, (known["set_digest"] == firsts["set_digest"]) & (known["doc_id"] == firsts["id"])).select("id", F.col("n_shingles").alias("n"), "signature").dropDuplicates(["id"]), "classes")
    compared = written(candidates(classes), "candidates", LARGE)
    pairs = compared.filter("b IS NOT NULL").select("a", "b", "agree")
    links, parts = _linked(docs, pairs)
    keys = written(compared.filter(F.col("b").isNull() & ((F.col("size") > RUN) | (F.col("parts") > 1))).select(F.col("a").alias("id")), "runs")
    more = crowded(docs, classes, keys, parts)
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    for old in (more, keys, compared, classes):
        forget(old)

    # classes to components, members to classes; the smallest id of a component is that of a class
    of_class = firsts.join(parts, "id", "left").select(F.col("set_digest").alias("_digest"), F.coalesce("component", "id").alias("component_id"))
    grouped = known.join(of_class, known["set_digest"] == of_class["_digest"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("doc_id IS NULL OR set_digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return written(grouped.unionByName(alone), "near-groups")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs; see keyed()."""
    return keyed(docs)[0].select("doc_id", "n_shingles", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs; see keyed()."""
    return groups(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: those of one doc_id of each group.

    Null and empty texts and null doc_ids stay; repeated rows stay or go together; of rows with one doc_id and different
    texts each stays or goes by its own text. An empty table stays empty.
    """
    found, twice = keyed(docs)
    gone = written(found.filter("doc_id <> component_id").select(F.col("key").alias("id")).distinct(), "near-copies", LARGE)
    plain, names, where = hidden(docs)
    if twice.isEmpty():
        return shown(without(plain, F.col(where["doc_id"]).cast("long"), gone), names)
    plain = apart(plain.withColumns({"doc_id": F.col(where["doc_id"]).cast("long"), "text": F.col(where["text"]).cast("string")}), twice)
    return shown(without(plain, F.col("_key"), gone), names)
