"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget_stored, stored

MAX_ROUNDS = 60          # each round shortens every chain by a constant factor


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges(a, b)`` (longs).

    A node's neighbours are only ever reduced to their minimum, never gathered, so a
    node with very many neighbours is one aggregation key with map-side combine.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .filter(F.col("a") > F.col("b")).distinct(), "component-edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") > F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        before, now = now, stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") > F.col("b"))
                     .union(least.select("a", F.col("m").alias("b"))).distinct(), "component-edges")
        forget_stored(before)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
