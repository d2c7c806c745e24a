"""Connected components by alternating stars; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from raresight.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, root), root being the smallest node it reaches.

    Only nodes that have an edge are returned, roots included; loops and repeated
    edges don't matter. Each round points every node at the smallest neighbour
    (large star, small star) and is written to the shared folder; the rounds grow
    with the logarithm of the longest chain.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least).distinct())
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
