"""Leader clustering: rows in order, each joining the earliest leader that it is similar to, else leading itself.

The order makes this sequential, but a row's fate hangs on its earlier similar rows alone. All similar pairs are found once (a prefix
filter, exact), then rounds settle every row whose earlier neighbours are settled: one without a leader among them leads. A
round is two joins over the pairs; rounds are as many as the longest chain of dependent decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise


def similar_pairs(rows: DataFrame, least: float) -> DataFrame:
    """``block, u, v`` (u < v) of the rows of a written table ``block, id, terms`` (distinct) whose Jaccard similarity is at least ``least``.

    Of a set ordered from its rarest term in the block, two sets that similar share one of the first ``size - ceil(least size) + 1``.
    """
    each = rows.select("block", "id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    frequency = each.groupBy("block", "term").agg(F.count("*").alias("df")).where("df > 1")
    every = each.join(frequency, ["block", "term"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("block", "id").orderBy("df", "term"))
    front = every.withColumn("p", place).where((F.col("p") <= F.col("n") - F.ceil(F.col("n") * least) + 1) & (F.col("df") > 1))
    left = front.select("block", "term", F.col("id").alias("u"), F.col("n").alias("nu"))
    right = front.select("block", "term", F.col("id").alias("v"), F.col("n").alias("nv"))
    fits = f"u < v and least(nu, nv) >= {least} * greatest(nu, nv)"
    pairs = left.join(right, ["block", "term"]).where(fits).select("block", "u", "v").distinct()
    sets = rows.select("block", F.col("id").alias("u"), F.col("terms").alias("x"))
    both = pairs.join(sets, ["block", "u"]).join(sets.select("block", F.col("u").alias("v"), F.col("x").alias("y")), ["block", "v"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= least * (F.size("x") + F.size("y") - shared)).select("block", "u", "v")


def leaders(rows: DataFrame, least: float = 0.42) -> DataFrame:
    """``block, id, leader`` of every row of ``block, id, terms``; ids give the order within a block. Empty sets lead themselves."""
    rows = materialise(rows.select("block", "id", F.array_distinct("terms").alias("terms")), "rows")
    pairs = materialise(similar_pairs(rows.where("size(terms) > 0"), least), "similar")
    later = pairs.select("block", F.col("v").alias("id")).distinct()
    # Rows without an earlier neighbour lead at once.
    led = rows.select("block", "id").join(later, ["block", "id"], "left_anti").select("block", "id", F.col("id").alias("leader"))
    settled = materialise(led, "settled")
    open_ = materialise(later, "open")
    while open_.limit(1).count():
        known = settled.select("block", F.col("id").alias("u"), (F.col("leader") == F.col("id")).alias("leads"))
        ahead = pairs.select("block", "u", F.col("v").alias("id")).join(open_, ["block", "id"]).join(known, ["block", "u"], "left")
        state = ahead.groupBy("block", "id").agg(F.min(F.when(F.col("leads"), F.col("u"))).alias("first"), F.min(F.when(F.col("leads").isNull(), F.col("u"))).alias("unknown"))
        # The earliest leader is known once nothing unsettled stands before it.
        sure = state.where("unknown is null or first < unknown").select("block", "id", F.coalesce("first", "id").alias("leader"))
        fresh = materialise(sure, "fresh")
        settled = materialise(settled.unionByName(fresh), "settled")
        open_ = materialise(open_.join(fresh, ["block", "id"], "left_anti"), "open")
    return settled
