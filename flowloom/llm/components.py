"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import written


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges`` (``a``, ``b``); the root is the smallest node.

    Each round links the larger neighbours of a node to its smallest neighbour, then the
    smaller ones; the number of rounds grows with the logarithm of the longest path. Groups are
    only aggregated and joined, so no component is gathered anywhere.
    """
    def size(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = written(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0")
    before, turn = None, 0
    while (seen := size(now)) != before and seen[0]:
        before, turn = seen, turn + 1
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, folder, f"{name}-{turn}-large")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(lower.select("a", "m")).distinct(), folder, f"{name}-{turn}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
