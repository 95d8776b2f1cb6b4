"""Distributed connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import materialise


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) with u > v are stars: every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or up + low > 1").isEmpty()


def _to_least(edges: DataFrame) -> DataFrame:
    """u, v and the least node m among u and all its neighbours. The groups are never gathered: a minimum, then a join that AQE may split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node that can be reached) for every node of ``edges`` (two long columns; nulls and loops are left out).

    Alternates two steps until the edges are stars: each node's larger neighbours are linked to its least one, then its smaller ones
    are. What remains is a star around the least node of each component; the number of rounds grows with the logarithm of the
    longest path. Each round is written to the shared folder.
    """
    start = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    now = materialise(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"), "edges")
        small = _to_least(large)
        pulled = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(pulled.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
