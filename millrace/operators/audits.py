"""Audits: what diversity adds to a list, and what is wrong with a set of judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Focus (or relevance, of a query without focus terms) that makes an addition useful, relevance of noise; shares that make a verdict.
USEFUL_FOCUS, USEFUL_RELEVANCE, NOISE_RELEVANCE = 0.25, 0.5, 0.35
PRECISE, FEW_NOISY, MANY_NOISY = 0.5, 0.25, 0.5


def diversity_gain(baseline: DataFrame, diverse: DataFrame) -> DataFrame:
    """A row a query: what the diverse list adds to the baseline's, how much of it is useful or noise, and the verdict.

    Both lists have ``query_id, doc_id, cluster, focus, relevance``; ``focus`` is null where the query has no focus terms. An addition is useful if its
    cluster is new to the baseline's list and it covers enough of the focus (without focus terms: is relevant enough); it is noise if it covers none
    and is hardly relevant. With an ``off_topic`` column nothing that an off-topic query gets is useful. Queries without a diverse list have no row.
    """
    plain = baseline.select("query_id", "doc_id", "cluster")
    old = plain.groupBy("query_id").agg(F.count("*").alias("n_old"), F.collect_set("cluster").alias("old_clusters"))
    marked = diverse.join(plain.select("query_id", "doc_id", F.lit(1).alias("_was")), ["query_id", "doc_id"], "left").join(old, "query_id", "left")
    added = F.col("_was").isNull()
    fresh = F.col("cluster").isNotNull() & ~F.coalesce(F.array_contains("old_clusters", F.col("cluster")), F.lit(False))
    off_topic = F.coalesce("off_topic", F.lit(False)) if "off_topic" in diverse.columns else F.lit(False)
    useful = added & fresh & ~off_topic & F.when(F.col("focus").isNotNull(), F.col("focus") >= USEFUL_FOCUS).otherwise(F.col("relevance") >= USEFUL_RELEVANCE)
    noisy = added & (F.coalesce("focus", F.lit(0.0)) == 0) & (F.col("relevance") < NOISE_RELEVANCE)
    g = marked.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(added).alias("added"), F.count_if(useful).alias("useful"), F.count_if(noisy).alias("noisy"), F.count_distinct("cluster").alias("clusters"),
        F.first(F.coalesce(F.size("old_clusters"), F.lit(0))).alias("old"), F.first(F.coalesce("n_old", F.lit(0))).alias("n_old"), F.bool_or(off_topic).alias("off_topic"),
    )
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    kept = F.col("n") - F.col("added")
    rows = g.select("query_id", "added", (F.col("n_old") - kept).alias("removed"), (F.col("clusters") - F.greatest(F.col("old"), F.lit(0))).alias("cluster_delta"), share(kept, F.col("n") + F.col("n_old") - kept).alias("overlap"), share(F.col("useful"), F.col("added")).alias("breadth_precision"), share(F.col("noisy"), F.col("added")).alias("noise_rate"), "off_topic")
    return rows.withColumn("verdict", verdict()).drop("off_topic")


def verdict() -> Column:
    useful = (F.col("breadth_precision") >= PRECISE) & (F.col("noise_rate") <= FEW_NOISY)
    return F.when(F.col("off_topic") & (F.col("cluster_delta") > 0), "off_topic_breadth_risk").when(F.col("cluster_delta") <= 0, "no_diversity_gain").when(useful, "useful_breadth").when(F.col("noise_rate") >= MANY_NOISY, "noisy_breadth").otherwise("mixed_breadth")


def qrels_issues(queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """``issue, query_id, doc_id``: what is wrong with ``queries (query_id, text)`` and ``judgments (query_id, doc_id, relevance)``, all as strings.

    Missing and repeated query ids, queries without a text or without judgments, blank documents, grades that are no numbers or negative, judgments of
    unknown queries, and documents judged twice for a query. A null and a blank string are both missing.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    none = F.lit(None).cast("string")
    grade = F.expr("try_cast(relevance as double)")
    found = queries.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    judged = judgments.select("query_id", F.lit(1).alias("_judged")).distinct()
    per_query = found.join(judged, "query_id", "left").select("query_id", none.alias("doc_id"), F.array_compact(F.array(
        F.when(blank("query_id"), F.lit("missing_query_id")), F.when(~blank("query_id") & (F.col("_n") > 1), F.lit("duplicate_query_id")), F.when(blank("text"), F.lit("missing_query_text")), F.when(F.col("_judged").isNull(), F.lit("missing_relevance")),
    )).alias("issues"))
    known = queries.select("query_id", F.lit(1).alias("_known")).distinct()
    twice = F.count("*").over(Window.partitionBy("query_id", "doc_id"))
    rows = judgments.withColumns({"_grade": grade, "_twice": twice}).join(known, "query_id", "left")
    per_judgment = rows.select("query_id", "doc_id", F.array_compact(F.array(
        F.when(blank("doc_id"), F.lit("blank_doc_id")), F.when(F.col("_grade").isNull() | F.isnan("_grade"), F.lit("invalid_relevance")), F.when(F.col("_grade") < 0, F.lit("negative_relevance")), F.when(F.col("_known").isNull(), F.lit("unknown_query")), F.when(~blank("doc_id") & (F.col("_twice") > 1), F.lit("duplicate_judgment")),
    )).alias("issues"))
    return per_query.unionByName(per_judgment).select(F.explode("issues").alias("issue"), "query_id", "doc_id").distinct()
