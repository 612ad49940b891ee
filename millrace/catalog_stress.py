"""Registered queries of perturbed queries, slices and stance-preserving lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_tuning import CAND, KNOWN, NAMED, candidates, metrics_sql
from .functions import fixed_policies
from .functions.storage import materialise
from .operators import audits, retrieval, stress, tuning
from .oracles import BM25, ROUGH, contains_any, words

LIST, FLOOR = 5, 1
TOPICS = {"first": ["anth", "ther"], "second": ["ing", "tion"], "third": ["zz"]}


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def ranking_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the BM25 lists hold when their queries are perturbed in five ways."""
    queries, docs = _asked(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = retrieval.tokenised(docs)
    other = stress.perturbed(queries).withColumn("n", F.array_position(F.array(*map(F.lit, stress.VARIANTS)), F.col("variant")))
    runs = retrieval.bm25_top_k(other.select((F.col("query_id") * 10 + F.col("n")).alias("query_id"), "text"), docs, 10, tokens)
    named = runs.select(F.expr("query_id div 10").alias("query_id"), F.element_at(F.array(*map(F.lit, stress.VARIANTS)), F.expr("cast(query_id % 10 as int)")).alias("variant"), "doc_id", "rank")
    return stress.stability(materialise(retrieval.bm25_top_k(queries, docs, 10, tokens), "base"), materialise(named, "runs"))


def slice_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the twelve policies in each slice of the queries."""
    rows, grades = candidates(spark, sf_dir)
    scores = tuning.policy_metrics(tuning.policy_runs(rows, KNOWN, fixed_policies.POLICIES), grades)
    return stress.slice_boards(scores, stress.sliced(_asked(spark, sf_dir), TOPICS))


def _stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the stance of their documents' review: toxic ones object, poor ones are mixed, good ones support."""
    rows, _ = candidates(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stance = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "mixed").when(F.col("quality") == 1, "supportive").otherwise("descriptive")
    return materialise(rows.join(labels, "doc_id", "left").select("query_id", "doc_id", "rank", "relevance", stance.alias("stance")), "stances")


def disagreement_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lists with and without a place for every stance: how much of the disagreement among the candidates they keep."""
    rows = _stances(spark, sf_dir)
    order = [F.desc("relevance"), F.asc("rank")]
    plain = retrieval.top_k(rows.withColumnRenamed("rank", "old"), LIST, [F.desc("relevance"), F.asc("old")])
    kept = stress.preserving(rows, LIST, FLOOR, order)
    both = [stress.preservation(rows, lists).withColumn("lists", F.lit(name)) for name, lists in (("plain", plain), ("preserving", kept))]
    return both[0].unionByName(both[1])


def diversity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one document a source adds to each query's five most relevant candidates."""
    rows, _ = candidates(spark, sf_dir)
    ranked = retrieval.top_k(rows.withColumnRenamed("rank", "old"), 20, [F.desc("relevance"), F.asc("old")]).select("query_id", "doc_id", F.col("source").alias("cluster"), F.col("overlap").alias("focus"), "relevance", "rank")
    ranked = materialise(ranked, "ranked")
    spread = retrieval.cap_per_parent(ranked, "cluster", 1).where(F.col("new_rank") <= LIST)
    return audits.diversity_gain(ranked.where(F.col("rank") <= LIST), spread)


def judgment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of judgments made of the labels: quality as grade (toxic ones negative, some no numbers), dealt over fifty queries of which some are unknown."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = labels.select((F.col("doc_id") % 50).cast("string").alias("query_id"), F.when(F.col("doc_id") % 97 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("doc_id"), F.when(F.col("doc_id") % 41 == 0, "good").when(F.col("toxic") == 1, "-1").otherwise(F.col("quality").cast("string")).alias("relevance"))
    return audits.qrels_issues(_asked(spark, sf_dir).select(F.col("query_id").cast("string").alias("query_id"), F.when(F.col("query_id") % 7 != 0, F.col("text")).alias("text")), judged)


QUERIES = {f.__name__: f for f in (ranking_stability, slice_boards, disagreement_preservation, diversity_audit, judgment_issues)}

W = words("text")
VARIED = f"""variants AS (SELECT item_id * 10 + 1 AS item_id, upper(coalesce(text, '')) AS text FROM benchmark
UNION ALL SELECT item_id * 10 + 2, array_to_string(list_concat({W}, {W}), ' ') FROM benchmark
UNION ALL SELECT item_id * 10 + 3, array_to_string(({W})[1 : ceil(len({W}) / 2)::INT], ' ') FROM benchmark
UNION ALL SELECT item_id * 10 + 4, array_to_string(list_reverse({W}), ' ') FROM benchmark
UNION ALL SELECT item_id * 10 + 5, array_to_string(list_filter({W}, lambda w, i: (i - 1) % 3 <> 2), ' ') FROM benchmark
UNION ALL SELECT item_id * 10, text FROM benchmark)"""
NAMES = "[" + ", ".join(f"'{v}'" for v in stress.VARIANTS) + "]"

ORACLE_SQL = {
    "ranking_stability": f"""WITH {VARIED}, {BM25.replace("FROM benchmark", "FROM variants")},
r AS (SELECT query_id // 10 AS q, query_id % 10 AS v, doc_id, rank FROM bm WHERE rank <= 10),
b AS (SELECT q, doc_id, rank AS was FROM r WHERE v = 0),
s AS (SELECT q, count(*) AS n, arg_min(doc_id, was) AS first FROM b GROUP BY q),
m AS (SELECT q, v, count(*) AS kept, avg(abs(rank - was)) AS shift FROM r JOIN b USING (q, doc_id) WHERE v > 0 GROUP BY ALL),
e AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS v FROM s)
SELECT e.q AS query_id, ({NAMES})[e.v] AS variant, round(coalesce(kept, 0) / n, 6) AS overlap, coalesce(first = r.doc_id, false) AS same_first, round(shift, 6) AS mean_shift
FROM e LEFT JOIN m ON m.q = e.q AND m.v = e.v LEFT JOIN r ON r.q = e.q AND r.v = e.v AND r.rank = 1""",
    "slice_boards": f"""WITH {CAND}, {NAMED}, {metrics_sql("runs", "policy")},
sl AS (SELECT item_id AS query_id, unnest(list_filter(['all', CASE WHEN len({ROUGH.format('text')}) >= 30 THEN 'long' ELSE 'short' END, {', '.join(f"CASE WHEN {contains_any('text', ws)} THEN 'topic_{n}' END" for n, ws in TOPICS.items())}], lambda s: s IS NOT NULL)) AS slice FROM benchmark),
g AS (SELECT slice, policy, count(*) AS queries, round(avg(ndcg), 6) AS mean FROM sl JOIN measured USING (query_id) GROUP BY ALL)
SELECT *, row_number() OVER w AS place, coalesce(round(lag(mean) OVER w - mean, 6) <= 0.01::DOUBLE, false) AS near_tie FROM g WINDOW w AS (PARTITION BY slice ORDER BY mean DESC, policy)""",
    "disagreement_preservation": f"""WITH {CAND},
st AS (SELECT query_id, doc_id, old_rank, relevance, CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'mixed' WHEN quality = 1 THEN 'supportive' ELSE 'descriptive' END AS stance FROM cand LEFT JOIN labels USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, old_rank) AS p, (row_number() OVER (PARTITION BY query_id, stance ORDER BY relevance DESC, old_rank) <= {FLOOR})::INT AS owed FROM st),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY owed DESC, relevance DESC, old_rank) AS n FROM o),
pool AS (SELECT query_id, list(DISTINCT stance) AS had FROM st GROUP BY query_id),
kept_ AS (SELECT 'plain' AS lists, query_id, list(DISTINCT stance) AS has FROM k WHERE p <= {LIST} GROUP BY query_id UNION ALL SELECT 'preserving', query_id, list(DISTINCT stance) FROM k WHERE n <= {LIST} GROUP BY query_id)
SELECT lists, query_id, len(had)::INT AS stances, len(has)::INT AS kept, round(len(list_intersect(had, has)) / len(had), 6) AS preserved,
  CASE WHEN list_contains(had, 'supportive') AND list_contains(had, 'critical') THEN (list_contains(has, 'supportive') AND list_contains(has, 'critical'))::INT ELSE 1 END AS contradiction_kept FROM pool JOIN kept_ USING (query_id)""",
    "diversity_audit": f"""WITH {CAND},
r AS (SELECT query_id, doc_id, source AS cluster, overlap AS focus, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, old_rank) AS rank FROM cand),
m AS (SELECT *, (row_number() OVER (PARTITION BY query_id, cluster ORDER BY rank) > 1)::INT AS o FROM r),
sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, rank) AS nr FROM m),
old AS (SELECT query_id, count(*) AS n_old, list(DISTINCT cluster) AS oc FROM r WHERE rank <= {LIST} GROUP BY query_id),
g AS (SELECT query_id, count(*) AS n, count(*) FILTER (rank > {LIST}) AS added, count(*) FILTER (rank > {LIST} AND NOT list_contains(oc, cluster) AND focus >= 0.25) AS useful, count(*) FILTER (rank > {LIST} AND focus = 0 AND relevance < 0.35) AS noisy, count(DISTINCT cluster) AS clusters, any_value(len(oc)) AS old, any_value(n_old) AS n_old FROM sp JOIN old USING (query_id) WHERE nr <= {LIST} GROUP BY query_id),
q AS (SELECT query_id, added, n_old - (n - added) AS removed, (clusters - old)::BIGINT AS cluster_delta, round((n - added) / (n_old + added), 6) AS overlap, round(coalesce(useful / nullif(added, 0), 0), 6) AS breadth_precision, round(coalesce(noisy / nullif(added, 0), 0), 6) AS noise_rate FROM g)
SELECT *, CASE WHEN cluster_delta <= 0 THEN 'no_diversity_gain' WHEN breadth_precision >= 0.5 AND noise_rate <= 0.25 THEN 'useful_breadth' WHEN noise_rate >= 0.5 THEN 'noisy_breadth' ELSE 'mixed_breadth' END AS verdict FROM q""",
    "judgment_issues": """WITH q AS (SELECT item_id::VARCHAR AS query_id, CASE WHEN item_id % 7 <> 0 THEN text END AS text FROM benchmark),
j AS (SELECT (doc_id % 50)::VARCHAR AS query_id, CASE WHEN doc_id % 97 = 0 THEN '' ELSE doc_id::VARCHAR END AS doc_id, CASE WHEN doc_id % 41 = 0 THEN 'good' WHEN toxic = 1 THEN '-1' ELSE quality::VARCHAR END AS relevance FROM labels),
jj AS (SELECT *, count(*) OVER (PARTITION BY query_id, doc_id) AS twice, TRY_CAST(relevance AS DOUBLE) AS grade, query_id IN (SELECT query_id FROM q) AS known FROM j)
SELECT 'missing_query_text' AS issue, query_id, NULL AS doc_id FROM q WHERE coalesce(trim(text), '') = ''
UNION SELECT 'missing_relevance', query_id, NULL FROM q WHERE query_id NOT IN (SELECT query_id FROM j)
UNION SELECT 'blank_doc_id', query_id, doc_id FROM jj WHERE doc_id = '' UNION SELECT 'invalid_relevance', query_id, doc_id FROM jj WHERE grade IS NULL UNION SELECT 'negative_relevance', query_id, doc_id FROM jj WHERE grade < 0
UNION SELECT 'unknown_query', query_id, doc_id FROM jj WHERE NOT known UNION SELECT 'duplicate_judgment', query_id, doc_id FROM jj WHERE doc_id <> '' AND twice > 1""",
}
