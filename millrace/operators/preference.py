"""Ridge and pairwise preference models, judged by leaving one query out.

Every query contributes one row of sums (counts, first and second moments of features and target). A fold's training sums are the
total's less its own, so all folds are fitted from one pass over the examples; the systems, of as many unknowns as features,
are solved in tasks, a row a fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise


def moments(rows: DataFrame, features: list[str], target: str, by: str = "query_id") -> DataFrame:
    """``by, n, sums, products`` of the features and the target (the last), products as an upper triangle row by row."""
    names = [F.col(n).cast("double") for n in [*features, target]]
    products = [F.sum(a * b) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.array(*[F.sum(a) for a in names]).alias("sums"), F.array(*products).alias("products"))


def solve(n: float, sums: np.ndarray, products: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Intercept, weights of z-scored features, means and scales; the intercept has no penalty. Rounded to 6."""
    k = len(sums) - 1
    if n <= 0:
        return 0.0, np.zeros(k), np.zeros(k), np.ones(k)
    full = np.zeros((k + 1, k + 1))
    full[np.triu_indices(k + 1)] = products
    full = full + np.triu(full, 1).T
    mean = sums / n
    centred = full / n - np.outer(mean, mean)
    variance = np.diag(centred)[:k]
    # A constant feature leaves a rest of rounding behind.
    constant = variance <= 1e-12 * np.maximum(1.0, mean[:k] ** 2)
    scale = np.where(constant, 1.0, np.sqrt(np.maximum(variance, 0)))
    x = centred[:k, :k] / np.outer(scale, scale) * n
    y = centred[:k, k] / scale * n
    x[constant, :], x[:, constant], y[constant] = 0.0, 0.0, 0.0
    weights = np.linalg.solve(x + penalty * np.eye(k), y)
    return round(float(mean[k]), 6), np.round(weights, 6), np.round(mean[:k], 6), np.round(scale, 6)


def total_of(folds: DataFrame, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The sums of all folds: one row."""
    row = folds.agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.element_at("sums", i + 1)) for i in range(width)]).alias("s"), F.array(*[F.sum(F.element_at("products", i + 1)) for i in range(width * (width + 1) // 2)]).alias("p")
    ).first()
    return float(row["n"] or 0), np.array([x or 0.0 for x in row["s"]]), np.array([x or 0.0 for x in row["p"]])


def fold_models(rows: DataFrame, features: list[str], target: str, penalty: float = 0.75, by: str = "query_id") -> DataFrame:
    """``by, intercept, weights, means, scales``: for each query the model of all others; with one query, its own."""
    folds = materialise(moments(rows, features, target, by), "moments")
    n, sums, products = total_of(folds, len(features) + 1)

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, m, s, p in part[[by, "n", "sums", "products"]].itertuples(index=False):
                rest = (n - m, sums - s, products - p) if n > m else (n, sums, products)
                intercept, weights, means, scales = solve(*rest, penalty)
                out.append((key, intercept, weights.tolist(), means.tolist(), scales.tolist()))
            yield pd.DataFrame(out, columns=[by, "intercept", "weights", "means", "scales"])

    kind = rows.schema[by].dataType.simpleString()
    return folds.mapInPandas(fit, f"{by} {kind}, intercept double, weights array<double>, means array<double>, scales array<double>")


def predicted(rows: DataFrame, models: DataFrame, features: list[str], by: str = "query_id") -> DataFrame:
    """Add ``prediction``, between 0 and 1 and rounded to 6, by the model of each row's query."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    scaled = F.zip_with(F.zip_with(F.zip_with(x, "means", lambda a, m: a - m), "scales", lambda d, s: d / s), "weights", lambda z, w: z * w)
    value = F.aggregate(scaled, F.col("intercept"), lambda a, v: a + v)
    return rows.join(models, by).withColumn("prediction", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)).drop("intercept", "weights", "means", "scales")


def pairs(examples: DataFrame, features: list[str], target: str, key: str = "policy", least: float = 0.025) -> DataFrame:
    """Within each query, both orders of every two examples whose targets differ by ``least``: differences of features and ``preferred`` (0, 1).

    A query has one example a policy, so its pairs are bounded by the policies, whatever the corpus.
    """
    other = examples.select("query_id", F.col(key).alias("_key"), F.col(target).alias("_target"), *[F.col(f).alias(f"_{f}") for f in features])
    both = examples.join(other, "query_id").where(F.col(key) != F.col("_key"))
    margin = F.round(F.col(target) - F.col("_target"), 9)
    return both.where(F.abs(margin) >= least).select(
        "query_id", F.col(key).alias("left"), F.col("_key").alias("right"), F.round(F.abs(margin), 6).alias("margin"), (margin > 0).cast("double").alias("preferred"), *[(F.col(f) - F.col(f"_{f}")).alias(f) for f in features]
    )


def fold_report(examples: DataFrame, features: list[str], target: str, key: str = "policy", penalty: float = 0.75, least: float = 0.025) -> DataFrame:
    """Each query as a fold: ``n, mae, rmse`` of the ridge model and ``pairs, pair_accuracy, mean_margin, confidence`` of the pairwise one.

    Queries without a pair have null pair measures.
    """
    examples = materialise(examples.select("query_id", key, target, *features), "examples")
    fitted = predicted(examples, fold_models(examples, features, target, penalty), features)
    error = F.col("prediction") - F.col(target)
    ridge = fitted.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"))
    compared = materialise(pairs(examples, features, target, key, least), "pairs")
    judged = predicted(compared, fold_models(compared, features, "preferred", penalty), features)
    right = ((F.col("prediction") >= 0.5) == (F.col("preferred") >= 0.5)).cast("int")
    pairwise = judged.groupBy("query_id").agg(F.count("*").alias("pairs"), F.round(F.avg(right), 6).alias("pair_accuracy"), F.round(F.avg("margin"), 6).alias("mean_margin"), F.round(F.avg(F.abs(F.col("prediction") - 0.5) * 2), 6).alias("confidence"))
    return ridge.join(pairwise, "query_id", "left")
