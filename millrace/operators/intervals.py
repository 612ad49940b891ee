"""Overlap joins of half-open intervals within a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """All pairs of ``left (keys, l_start, l_end)`` and ``right (keys, r_start, r_end)`` that share a point.

    Each interval is dealt to the bins of ``width`` that it touches; rows meet in an equal bin, and a pair counts in the first bin
    that both touch, so that no duplicates are to be removed. Empty intervals overlap nothing. Choose ``width`` near the usual length.
    """

    def dealt(rows: DataFrame, side: str) -> DataFrame:
        start, end = F.col(f"{side}_start"), F.col(f"{side}_end")
        return rows.where(end > start).withColumn("_bin", F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))))

    both = dealt(left, "l").join(dealt(right, "r"), [*keys, "_bin"])
    first = F.floor(F.greatest("l_start", "r_start") / width)
    return both.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("_bin") == first)).drop("_bin")
