"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) to (node, component): each node that has an edge, and the smallest node it can reach.

    Every round keeps one edge table of at most as many rows; it is written to the shared folder, so a lost executor
    costs one round at most. The rounds end when a small-star leaves the table as it was, after O(log^2 n) of them at most.
    Defined results: edges with a null end and loops count as none; repeated or turned edges count once; an empty table gives an empty table.
    A hub of many edges is split by the adaptive skew join, and its minimum is taken before the shuffle.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # larger neighbours move to the smallest node of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = now.select("u", "v").groupBy("u").agg(F.min("v").alias("m"))
        large = materialise(large.unionAll(lowest.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal tables: how many edges, and two sums of their hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))).first())
