"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casario.session import cut_lineage


def _toward_least(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on (u, v) with v < u: neighbours of each node move to its least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    pairs = both.where(F.col("v") > F.col("u")) if large else both
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (u, v) edges of longs; the root is the least node of its component.

    The number of rounds grows with the logarithm of the longest path. A hub with many neighbours is aggregated
    partially before its shuffle, and its join is one that AQE can split.
    """
    now = cut_lineage(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v"), F.col("v")).distinct()
            )
        before = state
        now = cut_lineage(_toward_least(_toward_least(now, large=True), large=False))
