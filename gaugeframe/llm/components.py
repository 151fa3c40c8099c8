"""Connected components by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _size(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """``id, c``: for each id in ``edges(a, b)`` the smallest id of its component.

    In turn every node hands its larger neighbours, then its smaller ones, to its smallest
    neighbour, until only stars are left. Each step is a grouping with map-side minimum and
    a join on a node; nothing is collected.
    """
    edges = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b")
        .distinct()
    )
    before = None
    while (now := _size(edges)) != before:
        before = now
        # larger neighbours of each node to the smallest of all its neighbours and itself
        near = _both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            near.where("b > a")
            .join(least, "a")
            .select(F.col("m").alias("a"), "b")
            .where("a < b")
            .distinct()
        )
        # each node and its smaller neighbours to the smallest of them
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        edges = written(
            large.join(small, "b")
            .select(F.explode(F.array(F.struct("m", "b"), F.struct("m", F.col("a").alias("b")))))
            .select(F.col("col.m").alias("a"), F.col("col.b").alias("b"))
            .where("a < b")
            .distinct()
        )
    stars = edges.select(F.col("b").alias("id"), F.col("a").alias("c"))
    return stars.unionByName(stars.select(F.col("c").alias("id"), "c").distinct())
