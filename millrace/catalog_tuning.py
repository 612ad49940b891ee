"""Registered queries of policies, weight grids and preference models, with their SQL.

Candidates are each benchmark text's 20 best documents by BM25; a candidate's grade is its quality label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed_policies
from .functions.storage import materialise
from .operators import decisions, evidence, preference, retrieval, tuning
from .oracles import OVERLAP, SIGNALS, claims, safety, text_list, words
from .plans import staged

CANDIDATES = 20
#: Components of the weight grid, and how many steps a weight has: 126 weightings.
GRID_PARTS = ["relevance", "overlap", "claim_density", "method_signal", "evidence_specificity"]
STEPS = 5
FOLDS = (1, 2, 4, 8)
#: Components that the candidates have, with the names that the policies use.
KNOWN = ["relevance", "semantic_similarity", "claim_density", "method_signal", "limitation_signal", "evidence_specificity"]
#: Weights of the leaderboard's measures before any variant's changes.
MEASURES = {"ndcg": 0.3, "source_diversity": 0.1, "claim_coverage": 0.2, "context_relevance": 0.12, "support_confidence": 0.12}


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scored candidates, written, and their grades."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    tokens = retrieval.tokenised(docs)
    top = materialise(retrieval.bm25_top_k(queries, docs, CANDIDATES, tokens), "top")
    scored = retrieval.overlap_scores(queries, top, docs, tokens)
    wanted = docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi")
    signals = evidence.chunk_signals(wanted).join(wanted.select("doc_id", "source"), "doc_id")
    best = top.groupBy("query_id").agg(F.max("score").alias("most"))
    rows = top.join(best, "query_id").select("query_id", "doc_id", "rank", F.round(F.col("score") / F.col("most"), 6).alias("relevance"))
    rows = materialise(rows.join(scored, ["query_id", "doc_id"]).join(signals, "doc_id").withColumn("semantic_similarity", F.col("overlap")), "candidates")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rows, rows.select("query_id", "doc_id").join(labels.select("doc_id", F.col("quality").cast("double").alias("relevance")), "doc_id")


def policy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = candidates(spark, sf_dir)
    return tuning.policy_runs(rows, KNOWN, fixed_policies.POLICIES).select("query_id", "policy", "doc_id", "score", "rank")


def policy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.compared(policy_runs(spark, sf_dir))


def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, grades = candidates(spark, sf_dir)
    runs = tuning.policy_runs(rows, GRID_PARTS, tuning.simplex(GRID_PARTS, STEPS))
    each = tuning.policy_metrics(runs, grades)
    return each.groupBy("policy").agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 8).alias(f"mean_{n}") for n in ("ndcg", "recall", "ap", "rr")])


def weight_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, grades = candidates(spark, sf_dir)
    grid = tuning.simplex(GRID_PARTS, STEPS)

    def evaluate(policies: list[str], inside) -> DataFrame:
        runs = tuning.policy_runs(rows.where(inside), GRID_PARTS, {p: grid[p] for p in policies})
        return tuning.policy_metrics(runs, grades).select("policy", "query_id", F.col("ndcg").alias("value"))

    return spark.createDataFrame(tuning.successive_halving(evaluate, grid, FOLDS), "policy string, rung int, mean_ndcg double, place int")


def weight_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each policy's measures over its lists, and its place under each variant of the measures' weights."""
    rows, grades = candidates(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = materialise(tuning.policy_runs(rows, KNOWN, fixed_policies.POLICIES), "runs")
    listed = docs.join(runs.select("doc_id").distinct(), "doc_id", "left_semi")
    claimed = evidence.claims(listed).select("doc_id", F.lit(1).alias("claimed")).distinct()
    each = runs.join(claimed, "doc_id", "left").groupBy("policy", "query_id").agg(
        (F.count_distinct("source") / F.count("*")).alias("source_diversity"), F.avg(F.coalesce("claimed", F.lit(0))).alias("claim_coverage"), F.avg("relevance").alias("context_relevance"), F.avg("overlap").alias("support_confidence")
    )
    both = each.join(tuning.policy_metrics(runs, grades).select("policy", "query_id", "ndcg"), ["policy", "query_id"], "left")
    methods = both.groupBy(F.col("policy").alias("method")).agg(*[F.round(F.avg(n), 6).alias(n) for n in MEASURES])
    return tuning.leaderboards(methods, list(MEASURES), tuning.variant_weights(MEASURES, tuning.VARIANTS))


def stage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, grades = candidates(spark, sf_dir)
    orders = {"lexical": F.col("relevance"), "overlap": F.col("overlap"), "fused": F.round(F.col("relevance") * 0.45 + F.col("overlap") * 0.55, 6)}
    return tuning.stage_grid(rows, orders, [5, 10, 20], grades)


def preference_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples are the policies' lists: mean components as features, their nDCG as target; each query is a fold."""
    rows, grades = candidates(spark, sf_dir)
    runs = tuning.policy_runs(rows, KNOWN, fixed_policies.POLICIES)
    features = runs.groupBy("query_id", "policy").agg(*[F.round(F.avg(c), 6).alias(c) for c in KNOWN])
    examples = features.join(tuning.policy_metrics(runs, grades).select("query_id", "policy", "ndcg"), ["query_id", "policy"])
    return preference.fold_report(examples, KNOWN, "ndcg")


def evidence_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the twelve policies decides about each candidate, and why."""
    rows, _ = candidates(spark, sf_dir)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    wanted = docs.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    scanned = evidence.safety_scan(wanted, "text").select("doc_id", "decision")
    trust = labels.select("doc_id", (F.col("quality") * 0.5 + 0.1).alias("source_trust"), (F.col("toxic") == 1).alias("is_retracted"))
    rows = rows.join(scanned, "doc_id").join(trust, "doc_id", "left").join(decisions.controls(queries), "query_id").withColumn("excluded_share", F.lit(0.0))
    made = decisions.decided(rows, fixed_policies.POLICIES)
    return made.select("query_id", "doc_id", "policy", "utility", "decision", "reasons", ((F.col("decision") == "allow") & (F.col("utility") > 0.000002)).alias("counts"), "diversity")


def staged_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of all twelve policies, from one run of the first stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return staged.staged(queries, docs, policies=fixed_policies.POLICIES)


QUERIES = {f.__name__: f for f in (evidence_decisions, staged_policies, policy_runs, policy_comparison, weight_grid, weight_halving, weight_tuning, stage_grid, preference_folds)}


def weight_table(policies: tuning.Policies, parts: list[str]) -> str:
    rows = ", ".join(f"('{p}', {', '.join(f'{float(w.get(n, 0.0))!r}::DOUBLE' for n in parts)}, {sum(x for x in w.values() if x > 0) or 1.0!r}::DOUBLE)" for p, w in policies.items())
    return f"(VALUES {rows}) AS t(policy, {', '.join(f'w{i}' for i in range(len(parts)))}, total)"


CAND = f"""{OVERLAP},
sig AS (SELECT doc_id, source, {SIGNALS} FROM documents),
cand AS (SELECT ov.query_id, ov.doc_id, old_rank, source, round(bm_score / max(bm_score) OVER (PARTITION BY ov.query_id), 6) AS relevance, overlap, overlap AS semantic_similarity, claim_density, method_signal, limitation_signal, evidence_specificity FROM ov JOIN sig USING (doc_id)),
good AS (SELECT query_id, doc_id, quality::DOUBLE AS relevance FROM cand JOIN labels USING (doc_id) WHERE quality > 0),
ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN r <= 10 THEN (2 ** relevance - 1) / log2(r + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS r FROM good) GROUP BY query_id)"""


def runs_sql(policies: tuning.Policies, parts: list[str]) -> str:
    value = " + ".join(f"{p} * w{i}" for i, p in enumerate(parts))
    return f"""wt AS (SELECT * FROM {weight_table(policies, parts)}),
scored2 AS (SELECT cand.*, policy, round(({value}) / total, 6) AS score FROM cand, wt),
runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, policy ORDER BY score DESC, doc_id) AS rank FROM scored2) WHERE rank <= 10)"""


def metrics_sql(runs: str, by: str) -> str:
    """``measured``: the four measures of each list ``(query_id, by)`` of ``runs``."""
    return f"""hits AS (SELECT r.*, g.relevance AS grade, row_number() OVER (PARTITION BY query_id, {by} ORDER BY rank) AS nth FROM {runs} r JOIN good g USING (query_id, doc_id)),
got AS (SELECT query_id, {by}, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg, count(*) AS hits, sum(nth / rank) AS prec, min(rank) AS first FROM hits GROUP BY ALL),
measured AS (SELECT query_id, {by}, relevant, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(hits / relevant, 0), 6) AS recall, round(coalesce(prec / least(relevant, 10), 0), 6) AS ap, round(coalesce(1.0 / first, 0), 6) AS rr
  FROM ideal JOIN (SELECT DISTINCT query_id, {by} FROM {runs}) USING (query_id) LEFT JOIN got USING (query_id, {by}))"""


NAMED, GRID = runs_sql(fixed_policies.POLICIES, KNOWN), runs_sql(tuning.simplex(GRID_PARTS, STEPS), GRID_PARTS)


def halving_sql() -> str:
    """Each rung ranks what is alive by its mean over the folds so far and keeps the better half."""
    steps = ["alive0 AS (SELECT policy FROM wt)", "folded2 AS (SELECT *, (('0x' || left(md5(query_id::VARCHAR), 2))::INT) % 8 AS f FROM measured)"]
    for rung, upto in enumerate(FOLDS, 1):
        last = rung == len(FOLDS)
        steps.append(f"m{rung} AS (SELECT policy, coalesce(sum(round(ndcg * 1000000)::BIGINT) // count(ndcg), 0) / 1000000 AS mean, row_number() OVER (ORDER BY coalesce(sum(round(ndcg * 1000000)::BIGINT) // count(ndcg), 0) / 1000000 DESC, policy) AS r, count(*) OVER () AS n FROM alive{rung - 1} LEFT JOIN (SELECT * FROM folded2 WHERE f < {upto}) USING (policy) GROUP BY policy)")
        if not last:
            steps.append(f"alive{rung} AS (SELECT policy FROM m{rung} WHERE r <= ceil(n / 2))")
    out = " UNION ALL ".join(f"SELECT policy, {k} AS rung, mean, r FROM m{k}" + ("" if k == len(FOLDS) else " WHERE r > ceil(n / 2)") for k in range(1, len(FOLDS) + 1))
    return ",\n".join(steps) + f" SELECT policy, rung::INT AS rung, mean AS mean_ndcg, (row_number() OVER (ORDER BY rung DESC, r))::INT AS place FROM ({out})"


def tuning_sql() -> str:
    variants = tuning.variant_weights(MEASURES, tuning.VARIANTS)
    value = " + ".join(f"{n} * w{i}" for i, n in enumerate(MEASURES))
    own = claims().replace("toks AS", "ctoks AS").replace("FROM toks", "FROM ctoks")
    return f"""WITH {CAND}, {NAMED}, {metrics_sql("runs", "policy")}, {own},
said AS (SELECT DISTINCT doc_id, 1 AS claimed FROM kept),
each AS (SELECT policy, query_id, count(DISTINCT source) / count(*) AS source_diversity, avg(coalesce(claimed, 0)) AS claim_coverage, avg(relevance) AS context_relevance, avg(overlap) AS support_confidence FROM runs LEFT JOIN said USING (doc_id) GROUP BY ALL),
methods AS (SELECT policy AS method, {', '.join(f'round(avg({n}), 6) AS {n}' for n in MEASURES)} FROM each LEFT JOIN measured USING (policy, query_id) GROUP BY policy),
s AS (SELECT t.policy AS variant, method, round(({value}) / total, 6) AS score FROM methods, {weight_table(variants, list(MEASURES))})
SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, method) AS place FROM s"""


def stage_sql() -> str:
    total = " + ".join(f"greatest({n}, 0) * {w}::DOUBLE" if n == "gap" else f"{n} * {w}::DOUBLE" for n, w in tuning.OBJECTIVE.items())
    orders = {"lexical": "relevance", "overlap": "overlap", "fused": "round(relevance * 0.45::DOUBLE + overlap * 0.55::DOUBLE, 6)"}
    each = " UNION ALL ".join(f"SELECT query_id, doc_id, candidates, '{n}' AS ranking, ({c})::DOUBLE AS score FROM sized" for n, c in orders.items())
    by = "candidates, ranking"
    return f"""WITH {CAND}, sized AS (SELECT * FROM cand, (SELECT unnest([5, 10, 20]) AS candidates) WHERE old_rank <= candidates),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, {by} ORDER BY score DESC, doc_id) AS rank FROM ({each})),
runs AS (SELECT * FROM ranked2 WHERE rank <= 10), {metrics_sql("runs", by)},
reach AS (SELECT query_id, {by}, count(g.relevance) AS reached, coalesce(avg(CASE WHEN rank <= 10 AND g.relevance IS NOT NULL THEN score END), 0) - coalesce(avg(CASE WHEN rank <= 10 AND g.relevance IS NULL THEN score END), 0) AS gap FROM ranked2 LEFT JOIN good g USING (query_id, doc_id) GROUP BY ALL),
trial AS (SELECT {by}, count(*) AS queries, round(avg(round(reached / relevant, 6)), 6) AS candidate_recall, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(gap), 6) AS gap FROM measured JOIN reach USING (query_id, {by}) GROUP BY ALL),
c AS (SELECT *, round({total}, 6) AS composite FROM trial)
SELECT *, row_number() OVER (ORDER BY composite DESC, candidate_recall DESC, ndcg DESC, candidates, ranking) AS place FROM c"""


def decisions_sql() -> str:
    f, parts = fixed_policies, [p for p in fixed_policies.PARTS if p in KNOWN]
    names = [*decisions.SWITCHES]
    rows = ", ".join(f"('{n}', {', '.join(f'{float(w[p])!r}::DOUBLE' for p in parts)}, {sum(x for x in w.values() if x > 0)!r}::DOUBLE, {', '.join(f'{float(f.SWITCHES.get(n, {}).get(s, 0.0))!r}::DOUBLE' for s in names)})" for n, w in f.POLICIES.items())
    weighted = " + ".join(f"{p} * w{i}" for i, p in enumerate(parts))
    return f"""WITH {CAND}, {safety('documents', 'doc_id', 'text')},
pol AS (SELECT * FROM (VALUES {rows}) AS t(policy, {', '.join(f'w{i}' for i in range(len(parts)))}, total, {', '.join(names)})),
ctl AS (SELECT item_id AS query_id, len(list_intersect({words('text')}, {text_list(f.DISAGREEMENT_TERMS)})) > 0 AS wants, len(list_intersect(list_transform(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: trim(w, '.,;:!?')), {text_list(f.RETRACTION_TERMS)})) > 0 AS about FROM benchmark),
j AS (SELECT cand.*, pol.*, decision AS safe, coalesce(quality * 0.5::DOUBLE + 0.1::DOUBLE, 0) AS trust, coalesce(toxic = 1, false) AND NOT about AS gone, wants, relevance_floor > 0 AND relevance < relevance_floor AS below FROM cand JOIN scanned ON k = doc_id LEFT JOIN labels USING (doc_id) JOIN ctl USING (query_id), pol),
b AS (SELECT *, greatest(0, ({weighted}) / total - CASE WHEN below THEN low_relevance_penalty * ((relevance_floor - relevance) / relevance_floor) ELSE 0 END) AS base FROM j),
u AS (SELECT *, round((base + (method_signal_bonus * method_signal + limitation_signal_bonus * limitation_signal + evidence_specificity_bonus * evidence_specificity)) * least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * greatest(relevance, semantic_similarity) + 0.15::DOUBLE * 0.05::DOUBLE), 6) AS utility, safe IN ('block', 'quarantine') AS unsafe FROM b)
SELECT query_id, doc_id, policy, utility, CASE WHEN unsafe OR gone THEN 'reject' ELSE 'allow' END AS decision,
  CASE WHEN unsafe THEN 'safety_' || safe WHEN gone THEN 'integrity_gate_retracted' ELSE concat_ws(',', CASE WHEN below THEN 'below_relevance_floor' END, CASE WHEN safe = 'sanitize' THEN 'safety_sanitize_penalty' END, CASE WHEN trust < 0.25 THEN 'low_source_trust_penalty' END) END AS reasons,
  NOT (unsafe OR gone) AND utility > 0.000002::DOUBLE AS counts,
  CASE WHEN wants THEN greatest(diversity, 0.25::DOUBLE) ELSE diversity END AS diversity FROM u"""


ORACLE_SQL = {
    "evidence_decisions": decisions_sql(),
    "policy_runs": f"WITH {CAND}, {NAMED} SELECT query_id, policy, doc_id, score, rank FROM runs",
    "policy_comparison": f"""WITH {CAND}, {NAMED}, e AS (SELECT query_id, doc_id, min(rank) AS best_rank, max(rank) AS worst_rank, count(*) AS policies, array_to_string(list_sort(list(policy || '=' || rank)), ',') AS ranks FROM runs GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, doc_id) AS place FROM e""",
    "weight_grid": f"WITH {CAND}, {GRID}, {metrics_sql('runs', 'policy')} SELECT policy, count(*) AS queries, {', '.join(f'round(avg({n}), 8) AS mean_{n}' for n in ('ndcg', 'recall', 'ap', 'rr'))} FROM measured GROUP BY policy",
    "weight_halving": f"WITH {CAND}, {GRID}, {metrics_sql('runs', 'policy')}, {halving_sql()}",
    "weight_tuning": tuning_sql(),
    "stage_grid": stage_sql(),
}
