"""Approximate nearest neighbours by inner product: projected kd-trees with a stopping test.

Vectors are lengthened by one coordinate to a common norm, so that the largest inner products are
the smallest distances. DIMS random projections with normal (2-stable) entries map distances so
that the squared projected distance over the squared distance is chi-square with DIMS degrees of
freedom. Every row is indexed: blocks of rows each have a kd-tree over the projections. A query
visits the leaves of each block's tree by projected distance and verifies what they hold on the original vectors;
it stops when, by the chi-square distribution, a row nearer than the k-th found would have been
met already with probability CONFIDENCE.

Queries come in blocks as well, so that a task holds one block of rows and one of queries whatever the sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

DIMS, LEAF, CONFIDENCE = 8, 64, 0.98
BLOCK, QUERY_BLOCK = 8192, 4096
SEED = 20240101


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(1, dims // 2):
            term = term * half / k
            total = total + term
        return np.where(half > 300, 1.0, 1 - np.exp(-np.minimum(half, 300)) * np.where(half > 300, 0, total))


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: halves at the median of the widest coordinate."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        span = points[rows].max(axis=0) - points[rows].min(axis=0)
        order = np.argpartition(points[rows, span.argmax()], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, norm2: float, confidence: float = CONFIDENCE) -> list[tuple[int, int, float]]:
    """(query, id, score) of each query's k nearest of a block that it finds."""
    # equal vectors are one point of the tree, with all their ids
    points, back = np.unique(vectors, axis=0, return_inverse=True)
    members = np.argsort(back, kind="stable")
    members = members[np.lexsort((ids[members], back[members]))]
    first = np.searchsorted(back[members], np.arange(len(points)))
    sizes = np.diff(np.r_[first, len(members)])
    draw = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, DIMS))
    extra = np.sqrt(np.maximum(0, norm2 - (points**2).sum(axis=1)))
    mapped = np.column_stack([points, extra]) @ draw
    asked = np.column_stack([queries, np.zeros(len(queries))]) @ draw
    leaves = kd_leaves(mapped)
    low = np.array([mapped[r].min(axis=0) for r in leaves])
    high = np.array([mapped[r].max(axis=0) for r in leaves])
    out = []
    length2 = (queries**2).sum(axis=1)
    for at in range(0, len(queries), 1024):
        q = queries[at : at + 1024]
        z = asked[at : at + 1024]
        near2 = np.zeros((len(q), len(leaves)))
        for d in range(DIMS):
            near2 += np.maximum(0, np.maximum(low[None, :, d] - z[:, d, None], z[:, d, None] - high[None, :, d])) ** 2
        order = near2.argsort(axis=1)
        best = np.full((len(q), k + 1), -np.inf)  # one more, since a query may find itself
        scores = np.full((len(q), len(points)), -np.inf)
        alive = np.arange(len(q))
        for step in range(len(leaves)):
            lower = near2[alive, order[alive, step]]
            d2 = np.maximum(length2[at + alive] + norm2 - 2 * best[alive, 0], 0)
            known = np.isfinite(best[alive, 0])
            with np.errstate(divide="ignore", invalid="ignore"):
                sure = known & (lower > 1e-9) & (chi_square(lower / np.maximum(d2, 1e-300), DIMS) >= confidence)
            alive = alive[~sure]
            if not len(alive):
                break
            visit = order[alive, step]
            for leaf in np.unique(visit):
                mine = alive[visit == leaf]
                rows = leaves[leaf]
                score = q[mine] @ points[rows].T
                scores[mine[:, None], rows] = score
                # the least of the k + 1 best so far comes first
                best[mine] = np.partition(np.concatenate([best[mine], score], axis=1), -(k + 1), axis=1)[:, -(k + 1) :]
        for i, vec in enumerate(q):
            me, rows = int(query_ids[at + i]), np.flatnonzero(scores[i] >= best[i].min() - 1e-9)
            rows = rows[np.isfinite(scores[i, rows])]
            exact = (points[rows] * vec).sum(axis=1)
            pairs = [(-float(s), int(x)) for s, r in zip(exact, rows, strict=True) for x in ids[members[first[r] : first[r] + min(sizes[r], k + 1)]]]
            pairs = sorted(p for p in pairs if p[1] != me)[:k]
            out += [(me, x, -s) for s, x in pairs]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: not null, not zero, all components finite."""
    rows = pick(vectors, vec_id="long", embedding="array<double>").filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("embedding", lambda x: x != 0)).withColumnRenamed("embedding", "v")


def search(vectors: DataFrame, k: int = 20, every: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose vec_id is divisible by `every`.

    Ties go to the smaller vec_id; with fewer than k other rows all are returned. Of vectors of
    other dimensions than the query's, none is a candidate. Repeated vec_ids count once, with the least of their vectors.
    """
    rows = written(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    blocks, query_blocks = max(1, math.ceil(stats["n"] / block)), max(1, math.ceil(stats["q"] / QUERY_BLOCK))
    norm2 = float(stats["norm2"] or 0.0)
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    left = rows.withColumn("block", part(blocks, 1)).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = rows.filter(F.col("vec_id") % every == 0).withColumn("query_block", part(query_blocks, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size in sorted({len(v) for v in asked["v"]} & {len(v) for v in some["v"]}):
            a, b = some[some["v"].map(len) == size], asked[asked["v"].map(len) == size]
            found += search_block(a["vec_id"].to_numpy(), np.stack(a["v"].to_list()), b["vec_id"].to_numpy(), np.stack(b["v"].to_list()), k, norm2)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    near = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInPandas(run, "query_id long, vec_id long, score double")
    # at most k rows of each block for a query
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
