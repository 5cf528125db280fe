"""Exact dedup: two-pass Bloom filtering; only rows whose hash may repeat are shuffled.

Pass 1 counts the slots of a counting Bloom filter over the hashes of all texts (a map-side
combined count by slot number: no row travels) and packs the slots that were hit twice or more
into bitmaps. Pass 2 reads the texts again: a row with a slot that was hit once can have no
copy and passes straight through; the others, true copies and the few false positives, are
grouped on the SHA-256 of their normalised text.

The filter has a power of two of bits, at least 16 a row and at most ``max_bits``: its bitmaps
are broadcast, at most 16 MB. Beyond that many rows the filter fills and more unique rows take
the grouped path, with the same result.

A copy group of any size is reduced map-side to its winner; the join back to its rows is a
sort-merge join that adaptive execution may split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, no_space, shown

HASHES = 2
MAX_BITS = 1 << 27


def _slots(digest: Column, bits: int) -> list[Column]:
    """The slots of a SHA-256 given in hexadecimal digits."""
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def _bit(bitmap: Column, slot: Column) -> Column:
    """Whether a slot's bit is set in the bitmap of its bucket, as bitmap_construct_agg lays it out."""
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the slots that two or more rows of (digest) hit."""
    hit = digests.select(F.explode(F.array(*_slots(F.col("digest"), bits))).alias("slot"))
    twice = hit.groupBy("slot").count().filter("count > 1")
    return twice.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def decided(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs under hidden() names with _digest, _keep_id, _size and _kept.

    Null texts count as empty; empty texts are equal to each other. Of equal texts, the row with
    the most code points in its original text stays, then that with the smallest doc_id (null
    last), then one of the repeated rows. An empty table gives an empty result.
    """
    plain, _, where = hidden(docs)
    text, doc_id = F.col(where["text"]), F.col(where["doc_id"])
    rows = plain.withColumns({"_digest": F.sha2(no_space(text).cast("binary"), 256), "_length": F.length(F.coalesce(text, F.lit(""))).cast("long"), "_id": doc_id.cast("long"), "_row": F.monotonically_increasing_id()})
    bits = min(max_bits, 1 << max(15, math.ceil(math.log2(16 * max(1, docs.count())))))
    maps = repeated_slots(rows.select(F.col("_digest").alias("digest")), bits)
    for k, slot in enumerate(_slots(F.col("_digest"), bits)):
        found = F.broadcast(maps.select(F.col("bucket").alias(f"_bucket{k}"), F.col("bitmap").alias(f"_bitmap{k}")))
        rows = rows.join(found, F.bitmap_bucket_number(slot) == F.col(f"_bucket{k}"), "left")
        rows = rows.withColumn(f"_hit{k}", _bit(F.col(f"_bitmap{k}"), slot)).drop(f"_bucket{k}", f"_bitmap{k}")
    may = F.lit(True)
    for k in range(HASHES):
        may = may & F.col(f"_hit{k}")
    once = rows.filter(~may).withColumns({"_keep_id": F.col("_id"), "_size": F.lit(1).cast("long"), "_kept": F.lit(True)})
    again = rows.filter(may)
    order = F.struct(F.col("_length"), F.coalesce(-F.col("_id"), F.lit(-(2**63)).cast("long")).alias("back"), (-F.col("_row")).alias("row"), F.col("_id").alias("id"))
    best = again.groupBy(F.col("_digest").alias("_of")).agg(F.max(order).alias("_best"), F.count("*").alias("_size"))
    again = again.join(best, F.col("_digest") == F.col("_of")).withColumns({"_keep_id": F.col("_best.id"), "_kept": F.col("_row") == -F.col("_best.row")})
    drop = ["_length", "_id", "_row", *(f"_hit{k}" for k in range(HASHES))]
    return once.drop(*drop).unionByName(again.drop(*drop, "_of", "_best"))


def exact_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; see decided()."""
    _, _, where = hidden(docs)
    return decided(docs, max_bits).select(F.col(where["doc_id"]).cast("long").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return shown(decided(docs, max_bits).filter("_kept"), docs.columns)


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""
