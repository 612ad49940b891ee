"""Staged retrieval: candidates, gates, policy scores, diverse selection and a trace."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_policies
from ..functions import text as T
from ..functions.storage import materialise
from ..operators import decisions, evidence
from ..operators.first_stage import first_stage

__all__ = ["diverse", "enriched", "explain", "first_stage", "rank_table", "staged", "stage_summary"]


def diverse(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """Greedy choice: the best score, raised by the policy's diversity while the candidate's cluster is not yet there.

    Candidates below the policy's relevance or focus floor get no such bonus. Ties go to the larger id.
    """
    rows = group.sort_values(["score", "doc_id"], ascending=[False, False]).reset_index(drop=True)
    bonus = rows.diversity.where((rows.relevance >= rows.diversity_relevance_floor) & (rows.focus >= rows.diversity_focus_floor), 0.0).tolist()
    scores, clusters = rows.score.tolist(), rows.cluster.tolist()
    used: set = set()
    chosen, final, open_rows = [], [], list(range(len(rows)))
    while open_rows and len(chosen) < k:
        values = [scores[i] + (bonus[i] if clusters[i] is not None and clusters[i] not in used else 0.0) for i in open_rows]
        at = max(range(len(values)), key=values.__getitem__)
        i = open_rows.pop(at)
        used.add(clusters[i])
        chosen.append(i)
        final.append(round(values[at], 6))
    out = rows.loc[chosen, ["query_id", "policy", "doc_id", "cluster", "score"]].copy()
    out["final_score"] = final
    out["rank"] = range(1, len(out) + 1)
    return out


def enriched(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with relevance and similarity raised by focus coverage, their texts' signals and safety decision.

    ``found`` is a written table; only its documents' texts are looked at.
    """
    wanted = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    signals = evidence.safety_scan(wanted, "text").select("doc_id", "source", "decision", *[F.round(c, 6).alias(n) for n, c in evidence.signal_columns(F.col("text")).items()])
    rows = found.join(signals, "doc_id")
    raised = {"relevance": F.greatest(F.col("lexical"), F.col("focus") * 0.5), "semantic_similarity": F.greatest(F.col("semantic"), F.col("focus") * 0.35), "syntax_relevance": F.col("syntax")}
    return rows.withColumns(raised)


def scored(queries: DataFrame, docs: DataFrame, policies: dict[str, dict[str, float]], candidates: int = 50) -> DataFrame:
    """Every candidate under every policy, with its decision; rejected ones too.

    The first stage runs once for all policies. A text's share of a query's excluded words is looked up only where a query excludes any.
    """
    rows = enriched(materialise(first_stage(queries, docs, candidates), "found"), docs)
    asked = materialise(decisions.controls(queries), "controls")
    unwanted = asked.where("size(excluded) > 0").select("query_id", "excluded")
    if not unwanted.limit(1).count():
        return decisions.decided(rows.join(asked.drop("excluded"), "query_id").withColumn("excluded_share", F.lit(0.0)), policies)
    words = docs.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    shares = rows.select("query_id", "doc_id").join(unwanted, "query_id").join(words, "doc_id").select("query_id", "doc_id", (F.size(F.array_intersect("excluded", "words")) / F.size("excluded")).alias("excluded_share"))
    return decisions.decided(rows.join(asked.drop("excluded"), "query_id").join(shares, ["query_id", "doc_id"], "left"), policies)


def staged(queries: DataFrame, docs: DataFrame, k: int = 10, candidates: int = 50, policies: dict[str, dict[str, float]] | None = None, bonus: float | None = None) -> DataFrame:
    """Candidates, signals, safety gate, query controls, evidence decision and diverse selection of each query under each policy.

    The balanced policy alone by default; ``bonus`` replaces the policies' own diversity. Components that the documents have no data for
    (citations, authors, year) count 0; a document's cluster is its ``cluster``, or its source where there is no such column. The selection is
    sequential by nature; it sees at most ``candidates`` rows of a query and policy at a time.
    """
    policies = policies or {"balanced": fixed_policies.POLICIES["balanced"]}
    rows = scored(queries, docs, policies, candidates).where("decision = 'allow' and score > 0")
    if bonus is not None:
        rows = rows.withColumn("diversity", F.lit(float(bonus)))
    if "cluster" not in rows.columns:
        rows = rows.withColumn("cluster", F.col("source"))
    rows = rows.select("query_id", "policy", "doc_id", F.col("cluster").cast("string").alias("cluster"), "score", "relevance", "focus", "diversity", "diversity_relevance_floor", "diversity_focus_floor")
    schema = "query_id long, policy string, doc_id long, cluster string, score double, final_score double, rank long"
    chosen = rows.groupBy("query_id", "policy").applyInPandas(lambda g: diverse(g, k), schema)
    chosen = chosen.withColumnRenamed("cluster", "source")
    return chosen.drop("policy") if len(policies) == 1 else chosen


def explain(ranked: DataFrame, parts: dict[str, float], most: int = 4) -> DataFrame:
    """Add ``contributions``: the largest weighted shares of a row's components, as text."""
    total = sum(w for w in parts.values() if w > 0)
    shares = F.array(*[F.struct(F.round(F.col(n) * w / total, 6).alias("share"), F.lit(n).alias("name")) for n, w in parts.items()])
    ordered = F.slice(F.reverse(F.array_sort(shares)), 1, most)
    return ranked.withColumn("contributions", F.array_join(F.transform(ordered, lambda s: F.concat_ws("=", s["name"], s["share"].cast("string"))), "; "))


def stage_summary(queries: DataFrame, docs: DataFrame, candidates: int = 50) -> DataFrame:
    """Rows of each query after each stage."""
    gated = enriched(materialise(first_stage(queries, docs, candidates), "found"), docs)
    return gated.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("decision").isin("allow", "sanitize")).alias("allowed"), F.count_if(F.col("decision") == "quarantine").alias("quarantined"), F.count_if(F.col("decision") == "block").alias("blocked"))


def rank_table(runs: DataFrame, methods: list[str]) -> DataFrame:
    """Each document's rank by every method, best first."""
    table = runs.groupBy("query_id", "doc_id").pivot("method", methods).agg(F.min("rank"))
    best = F.least(*[F.coalesce(F.col(m), F.lit(2**31 - 1)) for m in methods]) if len(methods) > 1 else F.col(methods[0])
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(best, "doc_id"))
    return table.withColumn("place", order)
