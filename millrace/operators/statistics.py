"""Resampling, paired tests, ridge fits and spread decisions over per-query metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise, small

MAX_BROADCAST_QUERIES = 1_000_000


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Number different rows from 0 in order: each by its place in its range, plus the rows of the ranges before."""
    ranged = materialise(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_at", within - 1).join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_at") + F.col("_start")).alias(name))


def draws(spark: SparkSession, n: int, samples: int, seed: int) -> DataFrame:
    """``draw, ordinal, times``: how often each of ``n`` queries is in each bootstrap draw.

    Every pick is a hash of the seed and its own number, so the table is made in tasks and is the same on any cluster.
    """
    picks = spark.range(samples * n).select(F.expr(f"id div {max(n, 1)}").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n, 1))).alias("ordinal"))
    return picks.groupBy("draw", "ordinal").agg(F.count("*").alias("times"))


def bootstrap(scores: DataFrame, metric: str, samples: int = 200, seed: int = 7) -> DataFrame:
    """``method, mean, low, high, wins``: 95 % interval of the mean and share of draws each method wins.

    ``scores`` has ``query_id, method`` and the metric. Ties go to the first method by name.
    """
    ordinals = numbered(scores.select("query_id").distinct(), "query_id", "ordinal")
    n = ordinals.count()
    table = draws(scores.sparkSession, n, samples, seed)
    each = scores.join(F.broadcast(ordinals) if small(ordinals, MAX_BROADCAST_QUERIES) else ordinals, "query_id").join(table, "ordinal")
    means = each.groupBy("draw", "method").agg(F.round(F.sum(F.col(metric) * F.col("times")) / n, 6).alias("m"))
    first = F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("m"), "method"))
    marked = means.withColumn("won", (first == 1).cast("int"))
    bounds = marked.groupBy("method").agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.round(F.avg("won"), 6).alias("wins"))
    return scores.groupBy("method").agg(F.round(F.avg(metric), 6).alias("mean")).join(bounds, "method")


def sign_flip(scores: DataFrame, metric: str, samples: int = 200, seed: int = 7) -> DataFrame:
    """For each pair of methods the mean difference and its sign-flip p-value, (extreme + 1) / (samples + 1)."""
    left = scores.select("query_id", F.col("method").alias("left_method"), F.col(metric).alias("x"))
    right = scores.select("query_id", F.col("method").alias("right_method"), F.col(metric).alias("y"))
    pairs = left.join(right, "query_id").where("left_method < right_method").withColumn("d", F.col("x") - F.col("y"))
    ordinals = numbered(scores.select("query_id").distinct(), "query_id", "ordinal")
    signs = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.struct(s.alias("sample"), F.when(F.xxhash64(F.lit(seed), s, F.col("ordinal")) % 2 == 0, 1).otherwise(-1).alias("sign")))
    flipped = pairs.join(F.broadcast(ordinals) if small(ordinals, MAX_BROADCAST_QUERIES) else ordinals, "query_id").select("left_method", "right_method", "d", F.inline(signs))
    totals = flipped.groupBy("left_method", "right_method", "sample").agg(F.abs(F.avg(F.col("d") * F.col("sign"))).alias("f"))
    observed = pairs.groupBy("left_method", "right_method").agg(F.avg("d").alias("mean"), F.count("*").alias("n"))
    both = totals.join(observed, ["left_method", "right_method"])
    found = both.groupBy("left_method", "right_method", "mean", "n").agg(F.count_if(F.col("f") >= F.abs("mean") - 1e-12).alias("extreme"))
    return found.select("left_method", "right_method", "n", F.round("mean", 6).alias("mean_difference"), F.round((F.col("extreme") + 1) / (samples + 1), 6).alias("p_value"))


def ridge(rows: DataFrame, features: list[str], target: str, penalty: float = 0.75) -> dict[str, float]:
    """Weights of z-scored features and an unpenalised intercept.

    Spark sums the Gram matrix in one pass; the driver solves a system of as many unknowns as features.
    """
    names = [*features, target]
    sums = {f"s{i}": F.sum(a) for i, a in enumerate(names)}
    sums |= {f"p{i}_{j}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    t = rows.agg(F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()]).first()
    n = t["n"]
    if not n:
        return {}
    mean = np.array([t[f"s{i}"] / n for i in range(len(names))])
    gram = np.array([[t[f"p{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))]) / n - np.outer(mean, mean)
    k = len(features)
    scale = np.sqrt(np.maximum(np.diag(gram)[:k], 0))
    scale[scale == 0] = 1.0
    x = gram[:k, :k] / np.outer(scale, scale) * n
    y = gram[:k, k] / scale * n
    weights = np.linalg.solve(x + penalty * np.eye(k), y)
    return {"intercept": float(mean[k])} | {f: float(w) for f, w in zip(features, weights, strict=True)}


def ridge_table(rows: DataFrame, features: list[str], target: str, penalty: float = 0.75) -> DataFrame:
    weights = ridge(rows, features, target, penalty)
    return rows.sparkSession.createDataFrame([(n, round(w, 6)) for n, w in weights.items()], "term string, weight double")


def spread_decision(runs: DataFrame, metric: str, baseline: str, least: float = 0.005) -> DataFrame:
    """Whether each treatment's paired difference to the baseline stands over its repeats."""
    base = runs.where(F.col("config") == baseline).select("repeat", F.col(metric).alias("b"))
    d = runs.where(F.col("config") != baseline).join(base, "repeat").withColumn("d", F.col(metric) - F.col("b"))
    g = d.groupBy("config").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.min("d").alias("low"), F.max("d").alias("high"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("std"))
    spread = F.col("high") - F.col("low")
    decision = F.when(F.col("n") < 3, "too_few_repeats").when((F.col("low") < 0) & (F.col("high") > 0), "direction_unstable").when(F.abs("mean") <= spread, "within_spread").when(F.abs("mean") < least, "too_small").otherwise("stands")
    return g.select("config", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(spread * 100, 6).alias("spread_pp"), decision.alias("decision"))
