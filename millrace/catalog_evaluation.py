"""Registered queries of joins, comparisons, slices and evaluation reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fixed
from .functions import text as T
from .functions.storage import materialise
from .operators import comparison, evidence, graph, metrics, retrieval
from .oracles import BM25, JUDGED, OVERLAP, ROUGH, SIGNALS, text_list, words

SIZES = [1, 3, 5, 10]
WEIGHTS = {"mean_ndcg": 0.4, "mean_recall": 0.2, "mean_ap": 0.2, "mean_rr": 0.2}
THRESHOLDS = {"mean_ndcg": 0.5, "mean_recall": 0.1, "mean_rr": 0.6}
ROLES = ["contradicting_source", "limitation_or_caveat", "method_detail", "corroborating_source", "direct_evidence", "contextual_background"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three rankings of each language's labelled documents, with quality as grade."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").select(F.col("lang").alias("query_id"), "doc_id", "n_chars", F.col("quality").cast("double").alias("relevance"))
    orders = {"longest": [F.desc("n_chars"), F.asc("doc_id")], "shortest": [F.asc("n_chars"), F.asc("doc_id")], "newest": [F.desc("doc_id")]}
    ranked = None
    for name, order in orders.items():
        one = retrieval.top_k(rows, 10, order).select("query_id", "doc_id", "rank", F.lit(name).alias("method"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked, rows.select("query_id", "doc_id", "relevance")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, qrels = runs(spark, sf_dir)
    return metrics.ranking_metrics(ranked, qrels, by=["query_id", "method"])


def score_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, qrels = runs(spark, sf_dir)
    return comparison.at_sizes(ranked, qrels, ["query_id", "method"], SIZES)


def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.recall_summary(_scores(spark, sf_dir), "method")


def method_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.composite(metrics.leaderboard(_scores(spark, sf_dir), "method"), WEIGHTS).select("method", "queries", "composite")


def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.gates(metrics.leaderboard(_scores(spark, sf_dir), "method"), "method", THRESHOLDS)


def worst_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten worst rows: a report of fixed length."""
    return _scores(spark, sf_dir).select("query_id", "method", "recall", "ndcg", "rr").orderBy("recall", "ndcg", "rr", "query_id", "method").limit(10)


def rank_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.movement(runs(spark, sf_dir)[0])


def added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.added_removed(runs(spark, sf_dir)[0], "longest")


def score_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.margins(retrieval.bm25_top_k(asked(spark, sf_dir), table(spark, sf_dir, "documents")))


def pooled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = asked(spark, sf_dir), table(spark, sf_dir, "documents")
    tokens = retrieval.tokenised(docs)
    lexical = materialise(retrieval.bm25_top_k(queries, docs, 20, tokens), "top")
    overlap = retrieval.top_k(retrieval.overlap_scores(queries, lexical, docs, tokens).withColumnRenamed("overlap", "score"), 20)
    return retrieval.pooled({"lexical": lexical, "overlap": overlap})


def sibling_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each role the ten longest turns, and the two longest other turns of their conversations."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("role").alias("query_id"), F.col("conv_id").alias("parent"), F.col("turn").alias("chunk"), F.char_length("text").alias("score"))
    ranked = retrieval.top_k(turns, 10, [F.desc("score"), F.asc("parent"), F.asc("chunk")])
    return retrieval.siblings(ranked, turns.select("parent", "chunk", F.col("score").alias("importance")), 2)


def parent_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of several lines have grade 2; the other turns of their conversations get 1."""
    turns = table(spark, sf_dir, "conversations")
    graded = turns.where(F.contains("text", F.lit("\n"))).select("conv_id", "turn", F.lit(2.0).alias("relevance"))
    return comparison.parent_qrels(graded, turns, "conv_id", "turn")


def chunk_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    qrels = docs.join(labels, "doc_id").select(F.col("lang").alias("query_id"), "doc_id", F.col("quality").cast("double").alias("relevance"))
    return comparison.expanded_qrels(qrels, evidence.sliding_windows(docs).select("doc_id", "chunk"))


def turn_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks, with the document of their conversation's number as work (inner) and its label as cluster (left)."""
    turns, docs, labels = (table(spark, sf_dir, n) for n in ("conversations", "documents", "labels"))
    both = turns.select(F.col("conv_id").alias("doc_id"), "role").join(docs.select("doc_id", "lang"), "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return both.groupBy("lang", "role", "quality").agg(F.count("*").alias("turns"))


def slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    return rows.groupBy("lang", size.alias("size")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("quality"), 6).alias("good_share"), F.round(F.avg("toxic"), 6).alias("toxic_share"))


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    level = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("bad")
    return comparison.required_coverage(rows, "source", level, ["good", "bad", "toxic", "unlabelled"], 3)


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.withColumn("rule", (F.col("n_chars") >= 1000).cast("int"))
    return comparison.agreement(rows, "lang", "quality", "rule")


def review_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed share, and good share of what was reviewed, of each source; and whether both reach their thresholds."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    g = rows.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("reviewed"), F.sum("quality").alias("good"))
    g = g.withColumns({"reviewed_rate": F.round(F.col("reviewed") / F.col("n"), 6), "good_rate": F.round(F.col("good") / F.nullif("reviewed", F.lit(0)), 6)})
    return g.select("source", "reviewed_rate", "good_rate", F.coalesce((F.col("reviewed_rate") >= 0.3) & (F.col("good_rate") >= 0.5), F.lit(False)).alias("passed"))


def unique_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the queries that are equal but for case and white space."""
    key = F.trim(F.regexp_replace(F.lower("text"), "[ \\t\\n\\r\\x0b\\f]+", " "))
    return asked(spark, sf_dir).groupBy(F.sha1(key).alias("query_key")).agg(F.min("query_id").alias("query_id"), F.count("*").alias("n"))


def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.distribution(table(spark, sf_dir, "events"), "event_type", "value")


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that order lines connect, by degree."""
    return comparison.degrees(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v")))


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each event type's users that are known customers: references restricted to what is in the corpus."""
    events, customers = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("known"))
    both = events.select("event_type", "user_id").join(customers, "user_id", "left")
    return both.groupBy("event_type").agg(F.count("*").alias("refs"), F.count("known").alias("matched"), F.round(F.count("known") / F.count("*"), 6).alias("matched_share"))


def run_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chained to the next one by id while the language stays: components are long paths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("next_lang"))
    edges = docs.join(following, "doc_id").where("lang = next_lang").select(F.col("doc_id").alias("u"), (F.col("doc_id") + 1).alias("v"))
    return graph.connected_components(edges)


def term_pairs(spark: SparkSession, sf_dir: str, terms: int = 30) -> DataFrame:
    """In how many documents two of the most frequent terms stand together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    each = docs.select("doc_id", F.explode("words").alias("term")).where("char_length(term) >= 4")
    top = each.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(terms)
    held = each.join(F.broadcast(top.select("term")), "term").groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("t"))  # at most ``terms`` a document
    pairs = held.select(F.posexplode("t").alias("i", "a"), "t").select("a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("documents"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's BM25 top ten with signals, overlap and the score's share of the best."""
    queries, docs = asked(spark, sf_dir), table(spark, sf_dir, "documents")
    tokens = retrieval.tokenised(docs)
    top = materialise(retrieval.bm25_top_k(queries, docs, tokens=tokens), "top")
    overlap = retrieval.overlap_scores(queries, top, docs, tokens)
    wanted = docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = top.join(overlap, ["query_id", "doc_id"]).join(evidence.chunk_signals(wanted), "doc_id").join(wanted.select("doc_id", "source"), "doc_id")
    return rows.withColumn("relevance", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6))


def context_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir)
    role = F.when(F.col("limitation_signal") >= 0.35, "limitation_or_caveat").when(F.col("method_signal") >= 0.35, "method_detail").when((F.col("overlap") >= 0.25) | (F.col("relevance") > 0), "direct_evidence").otherwise("contextual_background")
    rows = rows.withColumns({"role": role, "specificity": F.col("evidence_specificity")})
    return comparison.select_context(rows, ROLES, 5).select("query_id", "doc_id", "role", "place")


def support_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, docs = _evidence(spark, sf_dir), table(spark, sf_dir, "documents")
    focus = F.filter(F.array_distinct(T.tokens(F.col("text"))), lambda w: (F.char_length(w) >= 4) & ~w.isin(fixed.GENERIC_QUERY_TERMS))
    want = asked(spark, sf_dir).select("query_id", focus.alias("focus"))
    has = docs.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("has"))
    g = rows.join(has, "doc_id").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("has"))).alias("has"), F.round(F.avg("relevance"), 6).alias("relevance"), F.round(F.avg("overlap"), 6).alias("semantic"), F.countDistinct("source").alias("independent"))
    g = g.join(want, "query_id").select("query_id", F.size("focus").alias("n_focus"), F.size(F.filter("focus", lambda w: T.term_matches(w, F.col("has")))).alias("n_covered"), "relevance", "semantic", "independent", F.lit(0.0).alias("echo_risk"), F.lit(0).alias("contradictions"))
    return comparison.support(g).select("query_id", "coverage", "confidence", "level")


QUERIES = {
    f.__name__: f
    for f in (
        score_trajectory, candidate_recall, method_composite, metric_gates, worst_queries, rank_movement, added_removed, score_margins, pooled_candidates, sibling_turns, parent_grades, chunk_grades,
        turn_works, slice_summary, coverage_matrix, label_agreement, review_rates, unique_queries, nearest_rank_percentiles, value_distribution, graph_degrees, reference_edges, run_components,
        term_pairs, context_selection, support_levels,
    )
}

BOARD = f"{JUDGED}, board AS (SELECT method, count(*) AS queries, round(avg(ndcg), 8) AS mean_ndcg, round(avg(recall), 8) AS mean_recall, round(avg(ap), 8) AS mean_ap, round(avg(rr), 8) AS mean_rr FROM scores GROUP BY method)"
EVIDENCE = f"""{OVERLAP}, sig AS (SELECT doc_id, {SIGNALS} FROM documents),
ev AS (SELECT ov.query_id, ov.doc_id, bm_score AS score, old_rank AS rank, overlap, round(bm_score / max(bm_score) OVER (PARTITION BY query_id), 6) AS relevance, limitation_signal, method_signal, evidence_specificity FROM ov JOIN sig USING (doc_id) WHERE old_rank <= 10)"""
FOCUS = f"list_filter(list_distinct({words('text')}), lambda w: length(w) >= 4 AND NOT list_contains({text_list(fixed.GENERIC_QUERY_TERMS)}, w))"
LABELLED = "d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))"

ORACLE_SQL = {
    "score_trajectory": f"""WITH {JUDGED}, s AS (SELECT unnest({SIZES}) AS size), h AS (SELECT query_id, method, size, count(*) FILTER (relevance > 0 AND rank <= size) AS hits FROM top, s GROUP BY ALL)
SELECT query_id, method, size::INT AS size, hits, round(hits / relevant, 6) AS recall, round(hits / size, 6) AS precision FROM h JOIN ideal USING (query_id)""",
    "candidate_recall": f"WITH {JUDGED} SELECT method, count(*) AS queries, round(avg(recall), 8) AS mean_recall, round(avg(CASE WHEN recall > 0 THEN 1.0 ELSE 0 END), 8) AS hit_rate, count(*) FILTER (recall = 0) AS without_hits FROM scores GROUP BY method",
    "method_composite": f"WITH {BOARD} SELECT method, queries, round((mean_ndcg * 0.4::DOUBLE + mean_recall * 0.2::DOUBLE + mean_ap * 0.2::DOUBLE + mean_rr * 0.2::DOUBLE) / 1.0::DOUBLE, 6) AS composite FROM board",
    "metric_gates": f"WITH {BOARD}, e AS ({' UNION ALL '.join(f'SELECT method, {chr(39)}{n}{chr(39)} AS metric, {n} AS value, {t}::DOUBLE AS least FROM board' for n, t in THRESHOLDS.items())}) SELECT *, value >= least AS passed, bool_and(value >= least) OVER (PARTITION BY method) AS all_passed FROM e",
    "worst_queries": f"WITH {JUDGED} SELECT query_id, method, recall, ndcg, rr FROM scores ORDER BY recall, ndcg, rr, query_id, method LIMIT 10",
    "rank_movement": f"WITH {JUDGED} SELECT a.query_id, a.method AS left_method, b.method AS right_method, count(*) AS shared, round(avg(abs(a.rank - b.rank)), 6) AS mean_movement FROM top a JOIN top b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.method < b.method GROUP BY ALL",
    "added_removed": f"WITH {JUDGED}, b AS (SELECT query_id, doc_id FROM top WHERE method = 'longest'), n AS (SELECT query_id, count(*) AS n FROM b GROUP BY 1), o AS (SELECT t.query_id, t.method, count(*) FILTER (b.doc_id IS NULL) AS added, count(b.doc_id) AS shared FROM top t LEFT JOIN b USING (query_id, doc_id) WHERE t.method <> 'longest' GROUP BY ALL) SELECT query_id, method, added, n - shared AS removed FROM o JOIN n USING (query_id)",
    "score_margins": f"WITH {BM25}, g AS (SELECT query_id, rank, round(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), 6) AS gap FROM bm WHERE rank <= 10) SELECT query_id, max(gap) FILTER (rank = 1) AS margin, count(*) FILTER (gap <= 0.01) AS near_ties FROM g GROUP BY query_id",
    "pooled_candidates": f"""WITH {OVERLAP}, u AS (SELECT query_id, doc_id, old_rank AS rank, bm_score AS score, 'lexical' AS source FROM ov UNION ALL SELECT query_id, doc_id, rank2, overlap, 'overlap' FROM second),
p AS (SELECT query_id, doc_id, min(rank) AS best_rank, max(score) AS best_score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM u GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, best_score DESC, doc_id) AS place FROM p""",
    "sibling_turns": """WITH t AS (SELECT role AS query_id, conv_id AS parent, turn AS chunk, length(text) AS score FROM conversations WHERE text IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent, chunk) AS rank FROM t QUALIFY rank <= 10),
b AS (SELECT query_id, parent, min(rank) AS best_rank, max(score) AS best_score FROM r GROUP BY ALL), s AS (SELECT b.*, t.chunk, row_number() OVER (PARTITION BY b.query_id, parent ORDER BY t.score DESC, t.chunk) AS nth FROM b JOIN t USING (parent) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = b.query_id AND r.parent = b.parent AND r.chunk = t.chunk))
SELECT query_id, parent, chunk, best_rank + nth AS rank, round(best_score * 0.97::DOUBLE, 6) AS score FROM s WHERE nth <= 2""",
    "parent_grades": "WITH g AS (SELECT DISTINCT conv_id FROM conversations WHERE contains(text, chr(10))) SELECT conv_id, turn, CASE WHEN contains(text, chr(10)) THEN 2.0::DOUBLE ELSE 1.0 END AS relevance FROM conversations JOIN g USING (conv_id)",
    "chunk_grades": f"""WITH w AS (SELECT doc_id, lang, {ROUGH.format('text')} AS ws FROM documents), c AS (SELECT doc_id, lang, unnest(range(0, greatest(ceil((len(ws) - 180) / 140.0)::INT, 0) + 1)) AS chunk FROM w WHERE len(ws) > 0)
SELECT lang AS query_id, doc_id, chunk::INT AS chunk, quality::DOUBLE AS relevance FROM c JOIN labels USING (doc_id) WHERE quality > 0""",
    "turn_works": "SELECT lang, role, quality, count(*) AS turns FROM conversations c JOIN documents d ON c.conv_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL",
    "slice_summary": f"WITH {LABELLED} SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS size, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(avg(quality), 6) AS good_share, round(avg(toxic), 6) AS toxic_share FROM d GROUP BY ALL",
    "coverage_matrix": f"""WITH {LABELLED}, o AS (SELECT source, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS level, count(*) AS n FROM d GROUP BY ALL), w AS (SELECT DISTINCT source, unnest(['good', 'bad', 'toxic', 'unlabelled']) AS level FROM d)
SELECT source, level, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 3 THEN 'thin' ELSE 'covered' END AS status FROM w LEFT JOIN o USING (source, level)""",
    "label_agreement": "SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = (n_chars >= 1000)::INT THEN 1.0 ELSE 0 END), 6) AS exact_agreement, round(avg(abs(quality - (n_chars >= 1000)::INT)), 6) AS mean_distance FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "review_rates": f"WITH {LABELLED}, g AS (SELECT source, round(count(quality) / count(*), 6) AS reviewed_rate, round(sum(quality) / nullif(count(quality), 0), 6) AS good_rate FROM d GROUP BY source) SELECT *, coalesce(reviewed_rate >= 0.3 AND good_rate >= 0.5, false) AS passed FROM g",
    "unique_queries": "SELECT sha1(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g'))) AS query_key, min(item_id) AS query_id, count(*) AS n FROM benchmark GROUP BY 1",
    "nearest_rank_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(value) FILTER (i = round_even((n - 1) * 0.05::DOUBLE, 0)) AS p05, max(value) FILTER (i = round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(value) FILTER (i = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95 FROM r GROUP BY event_type""",
    "value_distribution": "SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(avg(value), 6) AS mean, max(value) AS high FROM events GROUP BY event_type",
    "graph_degrees": "SELECT node, count(*) AS degree FROM (SELECT l_partkey * 2 AS node FROM lineitem UNION ALL SELECT l_suppkey * 2 + 1 FROM lineitem) GROUP BY node",
    "reference_edges": "SELECT event_type, count(*) AS refs, count(c_custkey) AS matched, round(count(c_custkey) / count(*), 6) AS matched_share FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY event_type",
    "run_components": """WITH n AS (SELECT doc_id, lang, coalesce(doc_id - 1 = lag(doc_id) OVER (ORDER BY doc_id) AND lang = lag(lang) OVER (ORDER BY doc_id), false) AS joined FROM documents), g AS (SELECT doc_id, sum((NOT joined)::INT) OVER (ORDER BY doc_id) AS island FROM n),
s AS (SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY island) AS component, count(*) OVER (PARTITION BY island) AS n FROM g) SELECT node, component FROM s WHERE n > 1""",
    "term_pairs": f"""WITH e AS (SELECT doc_id, unnest(list_filter(list_distinct({words('text')}), lambda w: length(w) >= 4)) AS term FROM documents), t AS (SELECT term FROM e GROUP BY term ORDER BY count(*) DESC, term LIMIT 30), h AS (SELECT * FROM e JOIN t USING (term))
SELECT x.term AS a, y.term AS b, count(*) AS documents FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL""",
    "context_selection": f"""WITH {EVIDENCE}, r AS (SELECT *, CASE WHEN limitation_signal >= 0.35 THEN 'limitation_or_caveat' WHEN method_signal >= 0.35 THEN 'method_detail' WHEN overlap >= 0.25 OR relevance > 0 THEN 'direct_evidence' ELSE 'contextual_background' END AS role FROM ev),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY score DESC, relevance DESC, evidence_specificity DESC, rank) AS nth FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (nth = 1) DESC, CASE WHEN nth = 1 THEN list_position({text_list(ROLES)}, role) ELSE 0 END, score DESC, relevance DESC, evidence_specificity DESC, rank) AS place FROM n) SELECT query_id, doc_id, role, place FROM p WHERE place <= 5""",
    "support_levels": f"""WITH {EVIDENCE}, q AS (SELECT item_id AS query_id, {FOCUS} AS f FROM benchmark),
g AS (SELECT query_id, list_distinct(flatten(list(ws))) AS has, round(avg(relevance), 6) AS relevance, round(avg(overlap), 6) AS semantic, count(DISTINCT source) AS independent FROM ev JOIN toks USING (doc_id) JOIN documents USING (doc_id) GROUP BY query_id),
c AS (SELECT g.*, len(f) AS nf, len(list_filter(f, lambda x: list_contains(has, x) OR (x LIKE '%s' AND length(x) > 3 AND list_contains(has, x[:-2])) OR list_contains(has, x || 's'))) AS nc FROM g JOIN q USING (query_id)),
v AS (SELECT *, CASE WHEN nf > 0 THEN round(nc / nf, 6) ELSE 0 END AS coverage FROM c),
x AS (SELECT *, round(coverage * 0.65::DOUBLE + relevance * 0.2::DOUBLE + semantic * 0.15::DOUBLE, 6) AS raw FROM v),
y AS (SELECT *, CASE WHEN independent >= 2 THEN least(1.0::DOUBLE, round(raw + 0.08::DOUBLE, 6)) ELSE least(raw, 0.62::DOUBLE) END AS z FROM x),
k AS (SELECT *, CASE WHEN nf > 0 AND coverage = 0 THEN least(z, 0.3::DOUBLE) WHEN nf > 0 AND coverage < 0.25 THEN least(z, 0.34::DOUBLE) ELSE z END AS confidence FROM y)
SELECT query_id, coverage, confidence, CASE WHEN nf > 0 AND nc = 0 THEN 'weak' WHEN confidence < 0.35 THEN 'weak' WHEN confidence < 0.55 THEN 'moderate' ELSE 'strong' END AS level FROM k""",
}
