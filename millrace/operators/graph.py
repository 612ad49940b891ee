"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(u, v)`` of longs.

    ``component`` is the smallest node that can be reached. Alternating large-star and small-star
    steps, so the rounds grow with the logarithm of the longest chain; each round is written to the
    shared folder. Self loops, repeated edges and both directions are allowed; null ends are ignored.
    """
    stars = materialise(_down(edges.select("u", "v").where("u <> v")), "stars")
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        stars = materialise(_down(small), "stars")
        if _settled(stars):
            leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _settled(stars: DataFrame) -> bool:
    """True if every node has one edge, to a node that has none downwards."""
    ends = stars.groupBy("u").count().select(F.col("u").alias("n"), F.col("count").alias("down"), F.lit(0).alias("root"))
    roots = stars.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("root"))
    worst = ends.union(roots).groupBy("n").agg(F.sum("down").alias("down"), F.max("root").alias("root"))
    return worst.where("down > 1 or (down > 0 and root > 0)").limit(1).count() == 0
