"""Set operations, snapshots, profiles and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Texts that are equal after folding case and white space: hash, members, least id."""
    folded = F.trim(F.regexp_replace(F.lower("text"), "[ \\t\\n\\r\\x0b\\f]+", " "))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.substring(F.sha1(folded), 1, 16).alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_doc")).where("members > 1")


def manifest_diff(previous: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change``: added, removed, changed or unchanged."""
    a, b = previous.select(key, F.col(digest).alias("_a")), current.select(key, F.col(digest).alias("_b"))
    both = a.join(b, key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def merge_snapshots(tables: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """The first table's row of each key, with all names of tables that have it, sorted."""
    union = None
    for i, (name, df) in enumerate(tables):
        marked = df.withColumns({"_order": F.lit(i), "_mode": F.lit(name)})
        union = marked if union is None else union.unionByName(marked)
    columns = [c for c in tables[0][1].columns if c != key]
    row = F.min_by(F.struct(*columns), F.col("_order"))
    return union.groupBy(key).agg(row.alias("row"), F.array_join(F.array_sort(F.collect_set("_mode")), ",").alias("modes")).select(key, "row.*", "modes")


def coverage(df: DataFrame, by: list[str], predicates: dict[str, Column]) -> DataFrame:
    """Share of rows for which each predicate holds, rounded to 4."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(F.when(p, 1.0).otherwise(0.0)), 4).alias(n) for n, p in predicates.items()])


def stratified_sample(df: DataFrame, strata: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each stratum."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return df.withColumn("stratum_rank", rank).where(F.col("stratum_rank") <= most)


def topic_terms(docs: DataFrame, top: int = 100) -> DataFrame:
    """Terms by tf * ln(1 + N / df)."""
    words = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).where("char_length(term) >= 4")
    stats = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n_docs"))
    weight = F.round(F.col("tf") * F.log(1 + F.col("n_docs") / F.col("df")), 6)
    return stats.crossJoin(F.broadcast(n)).select("term", "tf", "df", weight.alias("weight")).orderBy(F.desc("weight"), "term").limit(top)


def topic_phrases(docs: DataFrame, n: int = 2, top: int = 50) -> DataFrame:
    """Runs of ``n`` content terms that stand at least twice, the most frequent first."""
    terms = F.filter(T.tokens(F.col("text")), lambda w: F.char_length(w) >= 4)
    grams = docs.select(terms.alias("terms")).select(F.explode(T.ngrams(F.col("terms"), n)).alias("phrase"))
    counted = grams.groupBy("phrase").agg(F.count("*").alias("n")).where("n >= 2")
    return counted.orderBy(F.desc("n"), "phrase").limit(top)


def activity(events: DataFrame, actor: str) -> DataFrame:
    """Each actor's rows and share of all rows."""
    counts = events.groupBy(actor).agg(F.count("*").alias("n"))
    total = events.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(actor, "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def daily_coverage(events: DataFrame, moment: str, kind: str) -> DataFrame:
    day = F.to_date(moment)
    return events.groupBy(kind, day.cast("string").alias("day")).agg(F.count("*").alias("n"), F.date_format(F.min(moment), "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format(F.max(moment), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def latency_percentiles(events: DataFrame, value: str, kind: str) -> DataFrame:
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return events.groupBy(kind).agg(F.count(value).alias("n"), *[F.round(F.percentile(value, p), 6).alias(n) for n, p in shares.items()])
