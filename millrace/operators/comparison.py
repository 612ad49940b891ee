"""Comparisons of rankings, slices, label tables and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_sizes(ranked: DataFrame, qrels: DataFrame, by: list[str], sizes: list[int]) -> DataFrame:
    """``size, hits, recall, precision`` of each list's first ``size`` documents; lists without hits have zeros."""
    good = qrels.where("relevance > 0")
    total = good.groupBy("query_id").agg(F.count("*").alias("relevant"))
    counts = [F.count_if((F.col("rank") <= k) & F.col("good")).alias(f"h{k}") for k in sizes]
    lists = ranked.join(good.select("query_id", "doc_id", F.lit(True).alias("good")), ["query_id", "doc_id"], "left").groupBy(*by).agg(*counts)
    each = lists.join(total, "query_id").select(*by, "relevant", F.inline(F.array(*[F.struct(F.lit(k).alias("size"), F.col(f"h{k}").alias("hits")) for k in sizes])))
    return each.select(*by, "size", "hits", F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"), F.round(F.col("hits") / F.col("size"), 6).alias("precision"))


def recall_summary(scores: DataFrame, by: str, recall: str = "recall") -> DataFrame:
    """Mean recall, share of queries with any hit, and how many have none."""
    return scores.groupBy(by).agg(F.count("*").alias("queries"), F.round(F.avg(recall), 8).alias("mean_recall"), F.round(F.avg((F.col(recall) > 0).cast("int")), 8).alias("hit_rate"), F.count_if(F.col(recall) == 0).alias("without_hits"))


def composite(scores: DataFrame, weights: dict[str, float], name: str = "composite") -> DataFrame:
    """Add the weighted mean of the named columns over the positive weights."""
    total = sum(w for w in weights.values() if w > 0)
    return scores.withColumn(name, F.round(reduce(Column.__add__, [F.col(n) * w for n, w in weights.items()]) / total, 6))


def margins(ranked: DataFrame, near: float = 0.01) -> DataFrame:
    """``query_id, margin, near_ties``: the lead of the first over the second, and how many neighbours are at most ``near`` apart."""
    gap = F.col("score") - F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))
    rows = ranked.withColumn("gap", F.round(gap, 6))
    return rows.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("gap"))).alias("margin"), F.count_if(F.col("gap") <= near).alias("near_ties"))


def movement(runs: DataFrame) -> DataFrame:
    """For each query and ordered pair of methods: shared documents and their mean absolute difference of ranks."""
    left = runs.select("query_id", "doc_id", F.col("method").alias("left_method"), F.col("rank").alias("r"))
    right = runs.select("query_id", "doc_id", F.col("method").alias("right_method"), F.col("rank").alias("s"))
    both = left.join(right, ["query_id", "doc_id"]).where("left_method < right_method")
    return both.groupBy("query_id", "left_method", "right_method").agg(F.count("*").alias("shared"), F.round(F.avg(F.abs(F.col("r") - F.col("s"))), 6).alias("mean_movement"))


def added_removed(runs: DataFrame, baseline: str) -> DataFrame:
    """For each query and other method: how many documents it adds to the baseline's list and how many it lacks."""
    base = runs.where(F.col("method") == baseline).select("query_id", "doc_id")
    others = runs.where(F.col("method") != baseline).select("query_id", "method", "doc_id")
    methods = others.select("query_id", "method").distinct()
    kept = others.join(base.withColumn("_base", F.lit(1)), ["query_id", "doc_id"], "left").groupBy("query_id", "method").agg(F.count_if(F.col("_base").isNull()).alias("added"), F.count_if(F.col("_base") == 1).alias("shared"))
    sizes = base.groupBy("query_id").agg(F.count("*").alias("n"))
    both = methods.join(kept, ["query_id", "method"]).join(sizes, "query_id", "left")
    return both.select("query_id", "method", "added", (F.coalesce("n", F.lit(0)) - F.col("shared")).alias("removed"))


def required_coverage(rows: DataFrame, by: str, level: Column, required: list[str], enough: int) -> DataFrame:
    """Observed rows of every required level for each value of ``by``, with a status."""
    observed = rows.select(F.col(by), level.alias("level")).groupBy(by, "level").agg(F.count("*").alias("n"))
    wanted = observed.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, required))).alias("level"))
    both = wanted.join(observed, [by, "level"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") < enough, "thin").otherwise("covered"))


def agreement(rows: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """Share of equal labels and mean distance of ordinal labels, where both are there."""
    both = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return both.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg((F.col(left) == F.col(right)).cast("int")), 6).alias("exact_agreement"), F.round(F.avg(F.abs(F.col(left) - F.col(right))), 6).alias("mean_distance"))


def gates(metrics: DataFrame, by: str, thresholds: dict[str, float]) -> DataFrame:
    """Each named metric against its least value, and whether all of a row's checks pass."""
    checks = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(float(t)).alias("least")) for n, t in thresholds.items()])
    each = metrics.select(by, F.inline(checks)).withColumn("passed", F.col("value") >= F.col("least"))
    return each.withColumn("all_passed", F.min("passed").over(Window.partitionBy(by)))


def nearest_rank(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles that are values of the data: the one at the place ``(n - 1) * share``, rounded half to even.

    Values are counted first, so the running count goes over distinct values and not over rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy(by))})

    def at(share: float) -> Column:
        place = F.bround((F.col("n") - 1) * share)
        return F.min(F.when(F.col("upto") > place, F.col(value)))

    return placed.groupBy(by).agg(F.max("n").alias("n"), *[at(s).alias(name) for name, s in shares.items()])


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Least, quartiles, mean and greatest of each group."""
    return rows.groupBy(by).agg(F.min(value).alias("low"), *[F.round(F.percentile(value, q), 6).alias(n) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))], F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("high"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, of both ends."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def expanded_qrels(qrels: DataFrame, chunks: DataFrame) -> DataFrame:
    """A document's positive grade for each of its chunks; documents without chunks go."""
    return qrels.where("relevance > 0").join(chunks.select("doc_id", "chunk"), "doc_id").select("query_id", "doc_id", "chunk", "relevance")


def parent_qrels(graded: DataFrame, chunks: DataFrame, parent: str, chunk: str) -> DataFrame:
    """Every chunk of a parent that has a graded chunk gets grade 1, unless it has one of its own."""
    relevant = graded.where("relevance > 0").select(parent).distinct()
    wide = chunks.join(relevant, parent, "left_semi").select(parent, chunk)
    both = wide.join(graded.select(parent, chunk, "relevance"), [parent, chunk], "full")
    return both.select(parent, chunk, F.coalesce("relevance", F.lit(1.0)).alias("relevance"))


def select_context(rows: DataFrame, roles: list[str], most: int) -> DataFrame:
    """The best row of each role, in the order of ``roles``, then the best of the rest, ``most`` a query.

    ``rows`` has ``query_id, doc_id, role, score, relevance, specificity, rank``.
    """
    better = [F.desc("score"), F.desc("relevance"), F.desc("specificity"), F.asc("rank")]
    rows = rows.withColumns({"_nth": F.row_number().over(Window.partitionBy("query_id", "role").orderBy(*better)), "_role": F.array_position(F.array(*map(F.lit, roles)), F.col("role"))})
    first = (F.col("_nth") == 1).cast("int")
    order = [F.desc(first), F.when(first == 1, F.col("_role")), *better]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= most).drop("_nth", "_role")


def support(rows: DataFrame) -> DataFrame:
    """Add ``confidence`` and ``level`` from ``n_focus, n_covered, relevance, semantic, independent, echo_risk, contradictions``."""
    c = F.col
    coverage = F.when(c("n_focus") > 0, F.round(c("n_covered") / c("n_focus"), 6)).otherwise(0.0)
    rows = rows.withColumn("coverage", coverage)
    x = F.round(c("coverage") * 0.65 + c("relevance") * 0.2 + c("semantic") * 0.15, 6)
    x = F.when(c("independent") >= 2, F.least(F.lit(1.0), F.round(x + 0.08, 6))).otherwise(F.least(x, F.lit(0.62)))
    x = F.when(c("echo_risk") >= 0.45, F.least(x, F.lit(0.42))).otherwise(x)
    x = F.when(c("contradictions") > 0, F.least(x, F.lit(0.58))).otherwise(x)
    x = F.when((c("n_focus") > 0) & (c("coverage") == 0), F.least(x, F.lit(0.3))).when((c("n_focus") > 0) & (c("coverage") < 0.25), F.least(x, F.lit(0.34))).otherwise(x)
    rows = rows.withColumn("confidence", x)
    level = F.when((c("n_focus") > 0) & (c("n_covered") == 0), "weak").when(c("confidence") < 0.35, "weak").when(c("confidence") < 0.55, "moderate").otherwise("strong")
    return rows.withColumn("level", level)
