"""The registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_evaluation as evaluation
from . import catalog_chunks, catalog_grounding, catalog_pools, catalog_stress, catalog_tuning
from . import catalog_signals as signals
from . import oracles
from .functions import fixed
from .functions import text as T
from .functions.storage import materialise
from .operators import chunking, corroboration, evidence, graph, metrics, relational, retrieval, statistics, trust
from .plans import staged
from .sources import readers, sinks

QUERY_STEP = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# Retrieval


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_top_k(asked(spark, sf_dir), table(spark, sf_dir, "documents"))


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_statistics(table(spark, sf_dir, "documents"))


def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(vectors.where(F.col("vec_id") % QUERY_STEP == 0), vectors)


def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = asked(spark, sf_dir), table(spark, sf_dir, "documents")
    tokens = retrieval.tokenised(docs)
    top = materialise(retrieval.bm25_top_k(queries, docs, 20, tokens), "top")
    scored = retrieval.overlap_scores(queries, top, docs, tokens).join(top.select("query_id", "doc_id", F.col("rank").alias("old_rank")), ["query_id", "doc_id"])
    return retrieval.top_k(scored, 10, [F.desc("overlap"), F.asc("old_rank")]).select("query_id", "doc_id", "overlap", "old_rank", "rank")


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries, docs = asked(spark, sf_dir), table(spark, sf_dir, "documents")
    tokens = retrieval.tokenised(docs)
    lexical = materialise(retrieval.bm25_top_k(queries, docs, 20, tokens), "top")
    overlap = retrieval.overlap_scores(queries, lexical, docs, tokens).withColumnRenamed("overlap", "score")
    return lexical, retrieval.top_k(overlap, 20)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion(list(_two_lists(spark, sf_dir)))


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.weighted_fusion(*_two_lists(spark, sf_dir))


def source_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = retrieval.bm25_top_k(asked(spark, sf_dir), docs).join(docs.select("doc_id", "source"), "doc_id")
    return retrieval.source_diversity(top, "source")


def near_duplicate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = retrieval.tokenised(docs)
    top = materialise(retrieval.bm25_top_k(asked(spark, sf_dir), docs, tokens=tokens), "top")
    return retrieval.near_duplicate_risk(top, docs, tokens=tokens)


def parent_cap_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    ranked = turns.select(F.col("role").alias("query_id"), "conv_id", "turn", F.row_number().over(retrieval.Window.partitionBy("role").orderBy(F.desc(F.char_length("text")), "conv_id", "turn")).alias("rank"))
    return retrieval.cap_per_parent(ranked, "conv_id", 2)


# Metrics


def _by_method(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three rankings of each language's labelled documents, with quality as grade."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").select(F.col("lang").alias("query_id"), "doc_id", "n_chars", F.col("quality").cast("double").alias("relevance"))
    orders = {"longest": [F.desc("n_chars"), F.asc("doc_id")], "shortest": [F.asc("n_chars"), F.asc("doc_id")], "newest": [F.desc("doc_id")]}
    ranked = None
    for name, order in orders.items():
        one = retrieval.top_k(rows, 10, order).select("query_id", "doc_id", "rank", F.lit(name).alias("method"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked, rows.select("query_id", "doc_id", "relevance")


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, qrels = _by_method(spark, sf_dir)
    return metrics.ranking_metrics(ranked.where("method = 'longest'"), qrels)


def policy_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, qrels = _by_method(spark, sf_dir)
    return metrics.leaderboard(metrics.ranking_metrics(ranked, qrels, by=["query_id", "method"]), "method")


def rank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, _ = _by_method(spark, sf_dir)
    lists = ranked.groupBy("query_id", "method").agg(F.collect_set("doc_id").alias("ids"))
    left = lists.select("query_id", F.col("method").alias("left_method"), F.col("ids").alias("x"))
    right = lists.select("query_id", F.col("method").alias("right_method"), F.col("ids").alias("y"))
    both = left.join(right, "query_id").where("left_method < right_method")
    share = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return both.select("query_id", "left_method", "right_method", F.round(share, 6).alias("overlap"))


def score_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return metrics.separation(docs.join(labels, "doc_id").select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("relevant")))


def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = evidence.chunk_signals(table(spark, sf_dir, "documents"))
    return metrics.summary(signals.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id"), ["lang"], ["n_chars", *fixed.SIGNAL_MARKERS])


def signal_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    x, y = F.col("n_chars").cast("double"), F.col("quality").cast("double")
    return rows.groupBy("lang").agg(F.round(metrics.pearson(x, y), 4).alias("correlation"), F.count("*").alias("n"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latency_percentiles(table(spark, sf_dir, "events"), "value", "event_type")


# Signals and evidence


def marker_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.chunk_signals(table(spark, sf_dir, "documents"))


def safety_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.safety_scan(table(spark, sf_dir, "documents"), "text").select("doc_id", "categories", "risk_score", "decision")


def page_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = evidence.safety_scan(table(spark, sf_dir, "pages"), "html", risky=True)
    return scanned.groupBy("decision", "categories").agg(F.count("*").alias("n"))


def claim_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.claims(table(spark, sf_dir, "documents")).select("doc_id", "position", "confidence", "stance", F.sha1("sentence").alias("sentence_sha1"))


def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts between claims, clustered by language; a labelled document's claims have the stance of its review, others that of their wording."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    review = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "mixed").otherwise("supportive")
    said = evidence.claims(docs).select("doc_id", "position", "stance", evidence.sorted_topics(F.col("_tokens")).alias("topics"))
    claims = said.join(docs.select("doc_id", F.col("lang").alias("cluster")), "doc_id").join(labels.select("doc_id", review.alias("review")), "doc_id", "left")
    return evidence.conflicts(claims.withColumn("stance", F.coalesce("review", "stance")))


def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = evidence.sliding_windows(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk", "token_start", "token_end", F.sha1("text").alias("text_sha1"))


def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = evidence.parent_context(table(spark, sf_dir, "conversations").where("text is not null"), "conv_id", "turn")
    return joined.select("conv_id", "parts", "tokens", F.sha1("context").alias("context_sha1"))


def theme_stance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    each = turns.select(T.opinion(F.col("text")).alias("stance"), F.explode(T.themes(F.col("text"))).alias("theme"))
    return each.groupBy("theme", "stance").agg(F.count("*").alias("n"))


def contact_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(T.has_contact(F.col("text"))).alias("with_contact"))


# Relational


def duplicate_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicate_groups(table(spark, sf_dir, "documents"))


def topic_profile_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.topic_terms(table(spark, sf_dir, "documents"))


def topic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.topic_phrases(table(spark, sf_dir, "documents"))


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    before = docs.join(labels, "doc_id").select("doc_id", F.sha2(F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text")), 256).alias("digest"))
    diff = relational.manifest_diff(before, docs.select("doc_id", F.sha2("text", 256).alias("digest")), "doc_id", "digest")
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def merged_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id").select("doc_id", "lang", "n_chars")
    clean = docs.join(labels.where("toxic = 0").select("doc_id"), "doc_id").select("doc_id", "lang", "n_chars")
    return relational.merge_snapshots([("good", good), ("clean", clean)], "doc_id")


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return relational.coverage(rows, ["lang"], {"labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "long": F.col("n_chars") >= 2000})


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return relational.stratified_sample(docs, ["lang", "source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


def author_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.activity(table(spark, sf_dir, "events"), "user_id")


def temporal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.daily_coverage(table(spark, sf_dir, "events"), "ts", "event_type")


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return graph.connected_components(orders.select((F.col("o_custkey") * 2).alias("u"), (F.col("o_orderkey") * 2 + 1).alias("v")))


def stale_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


# Plans and procedures


def first_stage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged.first_stage(asked(spark, sf_dir), table(spark, sf_dir, "documents"), 20)


def staged_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged.staged(asked(spark, sf_dir), table(spark, sf_dir, "documents"))


def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, _ = _by_method(spark, sf_dir)
    return staged.rank_table(ranked, ["longest", "newest", "shortest"])


def boundary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.boundary_chunks(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk", "token_start", "token_end", F.sha1("text").alias("text_sha1"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, qrels = _by_method(spark, sf_dir)
    return metrics.ranking_metrics(ranked, qrels, by=["query_id", "method"])


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.bootstrap(_scores(spark, sf_dir), "ndcg")


def paired_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.sign_flip(_scores(spark, sf_dir), "ndcg")


def ridge_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sized = docs.select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("log_chars"))
    rows = evidence.chunk_signals(docs).join(sized, "doc_id").join(labels, "doc_id")
    return statistics.ridge_table(rows.withColumn("grade", F.col("quality").cast("double")), ["claim_density", "uncertainty_signal", "log_chars"], "grade")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = readers.html_text(table(spark, sf_dir, "pages"))
    return read.select("page_id", "title", F.char_length("text").cast("long").alias("text_chars"), F.sha1("text").alias("text_sha1"))


def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    digest = F.sha2("text", 256)
    before = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, F.lit("old")).otherwise(digest).alias("digest"), F.lit("kept").alias("state"))
    after = docs.select("doc_id", digest.alias("digest"), F.lit("encoded").alias("state"))
    return sinks.refreshed(before, after, "doc_id", "digest")


def committee_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on each query's candidates: their scores, sources, domain fit, safety, kind, and the corroboration of their claims."""
    docs = table(spark, sf_dir, "documents")
    found = materialise(staged.first_stage(asked(spark, sf_dir), docs, 20), "found")
    wanted = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    scanned = evidence.safety_scan(wanted, "text").select("doc_id", F.col("decision").alias("safety_decision"))
    facts = signals._fits(spark, sf_dir).select("doc_id", "source_trust", "is_retracted", "domain_fit_tier", (F.col("evidence_family") == "public_opinion").alias("is_public_opinion"))
    claims = evidence.claims(wanted).join(docs.select("doc_id", F.lower("source").alias("fingerprint")), "doc_id").join(found.select("query_id", "doc_id"), "doc_id")
    # A claim counts within its query's candidates alone, so the query is part of the key's source.
    keyed = claims.withColumn("claim_key", corroboration.claim_key(F.col("_tokens"))).where("claim_key <> ''")
    verdicts = corroboration.by_query(keyed)
    rows = found.join(scanned, "doc_id").join(facts, "doc_id").join(verdicts, "query_id", "left").withColumn("corroboration_verdict", F.coalesce("overall_verdict", F.lit("no_claims")))
    return trust.committee(rows).groupBy("query_id", "committee_decision", "allowed_uses").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_term_stats, knn_cosine_topk, heuristic_rerank, rrf_fusion, weighted_fusion, source_diversity, near_duplicate_risk, parent_cap_diversify,
        ir_metrics, policy_leaderboard, rank_overlap, score_separation, signal_summary, signal_correlation, latency_percentiles,
        marker_signals, safety_scan, page_safety, claim_features, claim_conflicts, sliding_chunks, parent_context, theme_stance_counts, contact_patterns,
        duplicate_text_groups, topic_profile_terms, topic_phrases, manifest_diff, merged_modes, coverage_report, stratified_sample, author_activity, temporal_coverage, connected_components, stale_ids,
        first_stage_candidates, staged_retrieval, rank_table, boundary_chunks, bootstrap_ci, paired_significance, ridge_calibration, html_text, index_refresh, committee_decisions,
    )
}

QUERIES |= signals.QUERIES | evaluation.QUERIES | catalog_tuning.QUERIES | catalog_grounding.QUERIES | catalog_chunks.QUERIES | catalog_pools.QUERIES | catalog_stress.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | signals.ORACLE_SQL | evaluation.ORACLE_SQL | catalog_tuning.ORACLE_SQL | catalog_grounding.ORACLE_SQL | catalog_chunks.ORACLE_SQL | catalog_pools.ORACLE_SQL | catalog_stress.ORACLE_SQL
