"""Ranking metrics, distributions and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise


def ranking_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """``ndcg, recall, ap, rr`` at ``k`` for every query of ``qrels`` (``query_id, doc_id, relevance``), rounded to 6."""
    by = by or ["query_id"]
    good = qrels.where("relevance > 0")
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    # Only the first k of a query's relevant documents are ordered (each task hands on k); all are counted.
    best = good.withColumn("r", ideal_rank).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("r") + 1.0)).alias("ideal"))
    ideal = good.groupBy("query_id").agg(F.count("*").alias("relevant")).join(best, "query_id")
    hits = ranked.where(F.col("rank") <= k).join(good, ["query_id", "doc_id"])
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    found = hits.withColumn("nth", nth).groupBy(*by).agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("*").alias("hits"), F.sum(F.col("nth") / F.col("rank")).alias("precision"), F.min("rank").alias("first"))
    asked = ideal if by == ["query_id"] else ideal.join(ranked.select(*by).distinct(), "query_id")
    both = asked.join(found, by, "left")
    zero = F.lit(0.0)
    return both.select(
        *by,
        F.round(F.coalesce(F.col("dcg") / F.col("ideal"), zero), 6).alias("ndcg"),
        F.round(F.coalesce(F.col("hits") / F.col("relevant"), zero), 6).alias("recall"),
        F.round(F.coalesce(F.col("precision") / F.least(F.col("relevant"), F.lit(k)), zero), 6).alias("ap"),
        F.round(F.coalesce(1.0 / F.col("first"), zero), 6).alias("rr"),
    )


def leaderboard(metrics: DataFrame, method: str) -> DataFrame:
    names = ["ndcg", "recall", "ap", "rr"]
    return metrics.groupBy(method).agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 8).alias(f"mean_{n}") for n in names])


def pearson(x: Column, y: Column) -> Column:
    """0 where either is constant or there are fewer than two rows."""
    varies = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_pop(y), F.lit(0.0)) > 0)
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    mean_xy, mean_x, mean_y = F.avg(x * y), F.avg(x), F.avg(y)
    return F.when(varies & (n > 1), (mean_xy - mean_x * mean_y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).otherwise(0.0)


def summary(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Long form: ``signal, n, low, high, mean`` of each value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("signal"), F.col(v).cast("double").alias("value")) for v in values]))
    each = df.select(*by, pairs.alias("s")).select(*by, "s.signal", "s.value")
    return each.groupBy(*by, "signal").agg(F.count("value").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 6).alias("mean"))


def separation(scored: DataFrame) -> DataFrame:
    """Probability that a relevant score is above another (ties half), from ``score, relevant``; by rank sums.

    Scores are counted first. The running total goes over distinct scores, range by range; only the ranges' sums, one row each, meet.
    """
    counts = scored.groupBy("score").agg(F.sum(F.col("relevant").cast("long")).alias("p"), F.sum(1 - F.col("relevant").cast("long")).alias("q"))
    ranged = materialise(counts.repartitionByRange("score").withColumn("range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("range").agg(F.sum("q").alias("s"))
    starts = sums.select("range", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("q").over(Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("below", within).join(F.broadcast(starts), "range")
    wins = placed.withColumn("wins", F.col("p") * (F.col("below") + F.col("start") + F.col("q") / 2))
    total = wins.agg(F.sum("p").alias("relevant"), F.sum("q").alias("others"), F.sum("wins").alias("wins"))
    auc = F.when((F.col("relevant") > 0) & (F.col("others") > 0), F.col("wins") / F.nullif(F.col("relevant") * F.col("others"), F.lit(0)))
    return total.select("relevant", "others", F.round(auc, 6).alias("auc"), F.round(1 - 2 * F.abs(auc - 0.5), 6).alias("overlap"))
