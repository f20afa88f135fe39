"""Connected components by alternating large-star and small-star steps; nothing reaches the driver
but a count and a checksum of the edges in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.plans import storage


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of bigints: each node (node) that has one, with its component's least node (root)."""
    now = storage.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                          .where("a <> b").distinct(), "edges")
    before = None
    while (state := now.agg(F.count("*"), F.sum(F.hash("a", "b"))).first()) != before:
        before = state
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = storage.written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = storage.written(small.union(least.select("a", "least")).distinct(), "small-star")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct())
