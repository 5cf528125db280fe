"""Operators along an order: forward fill of markers, cut-off at an error, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCATEGORIZED = "_uncategorized"


def forward_fill(df: DataFrame, partition: list[str], order: list[str], marker: Column, name: str = "collection", default: str = UNCATEGORIZED) -> DataFrame:
    """Each row with the latest marker at or before it in its partition."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(marker, ignorenulls=True).over(w), F.lit(default)))


def cut_off(df: DataFrame, partition: list[str], order: str, failed: Column) -> DataFrame:
    """The rows of each partition before its first failed one."""
    first = df.filter(failed).groupBy(*partition).agg(F.min(order).alias("_first"))
    return df.join(first, partition, "left").filter(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")


def pick_first(df: DataFrame, partition: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each partition; Spark keeps no more of a partition than asked for."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def last_wins(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The value of each key that comes last."""
    return df.groupBy(*key).agg(F.max_by(value, order).alias(value))
