"""Hierarchies from declared levels: a flat table of nodes, with paths that sort in tree order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """One level: its rows, their key, the key of their parent (None at the top) and their title."""

    kind: str
    rows: DataFrame
    key: str
    parent: str | None
    title: Column
    has_raw: bool = True


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), key.cast("string"))


def sortable(key: Column) -> Column:
    """A key as text that sorts as the key does, whole: shorter ones first, so that numbers follow each other."""
    text = key.cast("string")
    return F.concat(F.lpad(F.length(text).cast("string"), 3, "0"), F.lit("."), text)


def nodes(levels: Sequence[Level]) -> DataFrame:
    """(node_id, parent_id, kind, title, depth, path_key, has_raw): levels joined from the top down.

    Rows whose parent doesn't exist are no nodes.
    """
    out, above = None, None
    for depth, level in enumerate(levels):
        key = F.col(level.key)
        own = level.rows.select(key.alias("_key"), (F.col(level.parent) if level.parent else F.lit(None)).alias("_parent"), node_id(level.kind, key).alias("node_id"), level.title.alias("title"))
        step = F.concat(F.lit("/" + level.kind + ":"), sortable(F.col("_key")))
        if above is None:
            placed = own.select("_key", "node_id", F.lit(None).cast("string").alias("parent_id"), "title", step.alias("path_key"))
        else:
            up = above.select(F.col("_key").alias("_up"), F.col("node_id").alias("parent_id"), F.col("path_key").alias("_path"))
            placed = own.join(up, F.col("_parent") == F.col("_up")).select("_key", "node_id", "parent_id", "title", F.concat("_path", step).alias("path_key"))
        part = placed.select("node_id", "parent_id", F.lit(level.kind).alias("kind"), "title", F.lit(depth).alias("depth"), "path_key", F.lit(level.has_raw).alias("has_raw"))
        out, above = part if out is None else out.unionByName(part), placed
    return out


def descendants(tree: DataFrame, node: str) -> DataFrame:
    """The nodes below one, by the beginning of their path."""
    at = tree.filter(F.col("node_id") == node).select(F.concat("path_key", F.lit("/")).alias("_under"))
    return tree.join(F.broadcast(at.limit(1)), F.col("path_key").startswith(F.col("_under"))).drop("_under")


def toggled(selected: DataFrame, tree: DataFrame, node: str, on: bool) -> DataFrame:
    """The selection (node_id) after a node and all below it are switched on or off."""
    touched = descendants(tree, node).select("node_id").unionByName(tree.filter(F.col("node_id") == node).select("node_id"))
    return selected.unionByName(touched).distinct() if on else selected.select("node_id").distinct().join(touched, "node_id", "left_anti")
