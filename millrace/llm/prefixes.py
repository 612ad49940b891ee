"""An exact set-similarity join by prefixes and bitmaps, for the sets that hub comparisons left apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITMAP_LONGS = 16


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Which of 1024 slots hold an odd number of the tokens (distinct 64-bit hashes), as 16 longs.

    Two bitmaps differ in at most as many bits as their sets do in tokens.
    """
    odd = np.bincount(tokens.view(np.uint64) % np.uint64(64 * BITMAP_LONGS), minlength=64 * BITMAP_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)`` of different components that may have a Jaccard similarity of ``percent``; none is missed.

    ``sets`` is a written table of ``node, component, size, tokens`` (distinct longs) and ``bits`` (their ``bitmap``). With each
    set's tokens ordered from the rarest, two sets that similar share a token within the first ``size - least overlap + 1``
    of both, and behind their first common one there must be enough tokens left in either; their bitmaps may not differ in more bits
    than such sets in tokens. All of this is tested where rows meet, so that a large group of texts that are alike but
    too far apart for a link makes next to no rows.
    """
    sizes = sets.groupBy("component").agg(F.count("*").alias("members"))
    each = sets.select("node", "component", F.explode("tokens").alias("token"))
    counts = each.groupBy("token", "component").agg(F.count("*").alias("n")).join(sizes, "component")
    # A token's main component: pairs need one end outside it, so its members are never compared with each other.
    frequency = counts.groupBy("token").agg(F.sum("n").alias("df"), F.max(F.struct("members", "component"))["component"].alias("main")).where("df > 1")
    # A token that one set alone has comes before all others there and makes no pair: its place is enough.
    common = each.select("node", "token").join(frequency, "token")
    ordered = Window.partitionBy("node").orderBy("df", "token")
    shared = common.withColumns({"nth": F.row_number().over(ordered) - 1, "all": F.count("*").over(Window.partitionBy("node"))})
    length = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    front = shared.join(sets.select("node", "component", "size", "bits"), "node").withColumn("place", F.col("nth") + F.col("size") - F.col("all")).where(F.col("place") < length)

    def side(c: str) -> DataFrame:
        return front.select("token", "main", F.col("node").alias(c), F.col("component").alias(f"c{c}"), F.col("size").alias(f"s{c}"), F.col("place").alias(f"p{c}"), F.col("bits").alias(f"b{c}"))

    differ = " + ".join(f"bit_count(bu[{i}] ^ bv[{i}])" for i in range(BITMAP_LONGS))
    enough = f"{100 + percent} * least(su - pu, sv - pv) >= {percent} * (su + sv) and {100 + percent} * ({differ}) <= {100 - percent} * (su + sv)"
    left, right = side("u").where("cu <> main"), side("v").withColumnRenamed("main", "other_main")
    both = left.join(right, (left["token"] == right["token"]) & F.expr(f"cu <> cv and (cv = other_main or u < v) and {enough}"))
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
