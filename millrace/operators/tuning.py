"""Policies over scored candidates: named runs, grids of weights, successive halving and a grid of stages.

Candidates are scored once. A policy is a row of weights, so any number of policies are ranked in one pass over the
candidates, without retrieving again: rows are dealt by query, then multiplied by the policies within their task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

Policies = dict[str, dict[str, float]]

# The stage grid's objective: weight of each measure, and of the penalties by mode (latency, cost).
OBJECTIVE = {"candidate_recall": 0.35, "ndcg": 0.30, "recall": 0.20, "rr": 0.10, "gap": 0.05}
PENALTIES = {"quality": (0.0, 0.0), "balanced": (0.05, 0.05), "low_latency": (0.20, 0.05), "low_cost": (0.05, 0.20)}
MOST_PENALTY = 0.25

# Changes to the weights of a leaderboard's measures, by variant.
VARIANTS = {
    "baseline": {},
    "support_heavy": {"support_confidence": 0.18, "context_relevance": 0.18},
    "conflict_heavy": {"conflict_awareness": 0.2, "cluster_diversity": 0.16},
    "source_diverse": {"source_diversity": 0.2, "cluster_diversity": 0.22},
    "recall_claims": {"claim_coverage": 0.3, "citation_support": 0.14},
}


def simplex(names: list[str], parts: int) -> Policies:
    """All weightings of the names by multiples of ``1 / parts`` that sum to 1, named by their numerators."""
    found = {}
    for counts in product(range(parts + 1), repeat=len(names)):
        if sum(counts) == parts:
            found["-".join(map(str, counts))] = {n: c / parts for n, c in zip(names, counts, strict=True)}
    return found


def policy_scores(candidates: DataFrame, components: list[str], policies: Policies) -> DataFrame:
    """Each candidate under each policy: ``policy`` and ``score``, the weighted mean over the policy's positive weights.

    Components that a policy does not name, or that are null, count 0; so do weights of components that are not there.
    """
    table = []
    for name, weights in policies.items():
        total = sum(w for w in weights.values() if w > 0) or 1.0
        own = [float(weights.get(c, 0.0)) for c in components]
        table.append(F.struct(F.lit(name).alias("policy"), F.array(*map(F.lit, own)).alias("w"), F.lit(float(total)).alias("total")))
    dealt = candidates.repartition("query_id").withColumn("_c", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in components]))
    each = dealt.select("*", F.explode(F.array(*table)).alias("_p"))
    parts = [F.element_at("_c", i + 1) * F.element_at("_p.w", i + 1) for i in range(len(components))]
    return each.select(*candidates.columns, F.col("_p.policy").alias("policy"), F.round(reduce(Column.__add__, parts) / F.col("_p.total"), 6).alias("score"))


def policy_runs(candidates: DataFrame, components: list[str], policies: Policies, k: int = 10) -> DataFrame:
    """The best ``k`` candidates of each query under each policy, with ``rank``; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id", "policy").orderBy(F.desc("score"), "doc_id"))
    return policy_scores(candidates, components, policies).withColumn("rank", rank).where(F.col("rank") <= k)


def compared(runs: DataFrame, by: str = "policy") -> DataFrame:
    """A row a query and document: its best rank, the policies that list it, the spread of its ranks, and the place by best rank."""
    each = runs.groupBy("query_id", "doc_id").agg(
        F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.count("*").alias("policies"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(by), F.col("rank").cast("string")))), ",").alias("ranks")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best_rank", "doc_id"))
    return each.withColumn("place", place)


def policy_metrics(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, policy, ndcg, recall, ap, rr``."""
    return metrics.ranking_metrics(runs.select("query_id", "policy", "doc_id", "rank"), qrels, k, by=["query_id", "policy"])


def fold(query_id: str = "query_id", folds: int = 8) -> Column:
    """0 to ``folds`` - 1 by the query's MD5, the same on any engine."""
    return F.conv(F.substring(F.md5(F.col(query_id).cast("string")), 1, 2), 16, 10).cast("int") % folds


def successive_halving(evaluate: Callable[[list[str], Column], DataFrame], policies: Iterable[str], folds: tuple[int, ...] = (1, 2, 4, 8)) -> list[tuple[str, int, float, int]]:
    """``policy, rung, mean, place``: policies measured on ever more queries, the better half of each rung going on.

    ``evaluate`` gives ``policy, query_id, value`` of some policies on the queries that a condition admits. A rung adds the queries of
    the folds below its number, so that none is scored twice and no dropped policy again. The driver holds one sum a policy, in
    millionths, so that means do not depend on the order of addition. A policy without a value has mean 0; ties go to the first by name.
    """
    alive, sums, found, done = sorted(policies), {}, [], 0
    for rung, upto in enumerate(folds, 1):
        inside = (fold() >= done) & (fold() < upto)
        for row in evaluate(alive, inside).groupBy("policy").agg(F.sum(F.round(F.col("value") * 1_000_000).cast("long")).alias("s"), F.count("value").alias("n")).collect():
            s, n = sums.get(row["policy"], (0, 0))
            sums[row["policy"]] = (s + row["s"], n + row["n"])
        means = {p: sums[p][0] // sums[p][1] / 1_000_000 if p in sums else 0.0 for p in alive}
        order = sorted(alive, key=lambda p: (-means[p], p))
        kept = order if rung == len(folds) else order[: -(-len(order) // 2)]
        out = order if rung == len(folds) else order[len(kept) :]
        found.append([(p, rung, means[p]) for p in out])
        alive, done = sorted(kept), upto
    ordered = [x for rung in reversed(found) for x in rung]
    return [(*x, place) for place, x in enumerate(ordered, 1)]


def variant_weights(base: dict[str, float], variants: dict[str, dict[str, float]]) -> Policies:
    """The weights of each variant: the base with some of them replaced or added."""
    return {name: base | changed for name, changed in variants.items()}


def leaderboards(methods: DataFrame, measures: list[str], weights: Policies) -> DataFrame:
    """``variant, method, score, place`` of every method under every variant of the weights; ties go to the first by name."""
    rows = methods.select(F.lit(0).alias("query_id"), "method", *measures)
    scored = policy_scores(rows, measures, weights).select(F.col("policy").alias("variant"), "method", "score")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("score"), "method")))


def objective(trials: DataFrame, mode: str = "quality", latency: Column | None = None, cost: Column | None = None) -> DataFrame:
    """Add ``composite``: the weighted measures less the mode's share of latency and cost (each at most a quarter)."""
    value = reduce(Column.__add__, [(F.greatest(F.col(n), F.lit(0.0)) if n == "gap" else F.col(n)) * w for n, w in OBJECTIVE.items()])
    for part, share in zip((latency, cost), PENALTIES[mode], strict=True):
        if part is not None and share:
            value = value - F.least(part, F.lit(MOST_PENALTY)) * share
    return trials.withColumn("composite", F.round(value, 6))


def stage_grid(pool: DataFrame, orders: dict[str, Column], sizes: list[int], qrels: DataFrame, k: int = 10) -> DataFrame:
    """Trials of ``candidates`` (how many first-stage rows) times ``ranking`` (how they are ordered), each over all queries.

    ``pool`` has ``query_id, doc_id, rank`` (of the first stage) and what the orders read. A trial has the means of candidate recall,
    nDCG, recall, reciprocal rank and ``gap`` (mean score of relevant less that of other rows of the list), and its place by ``composite``.
    """
    good = qrels.where("relevance > 0").select("query_id", "doc_id", "relevance")
    sized = pool.repartition("query_id").select("*", F.explode(F.array(*map(F.lit, sizes))).alias("candidates")).where(F.col("rank") <= F.col("candidates"))
    each = sized.select("query_id", "doc_id", "candidates", F.inline(F.array(*[F.struct(F.lit(n).alias("ranking"), c.cast("double").alias("score")) for n, c in orders.items()])))
    keys = ["query_id", "candidates", "ranking"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    ranked = each.withColumn("rank", place)
    marked = ranked.join(good, ["query_id", "doc_id"], "left")
    relevant = good.groupBy("query_id").agg(F.count("*").alias("relevant"))
    reach = marked.groupBy(*keys).agg(
        F.count("relevance").alias("reached"),
        (F.coalesce(F.avg(F.when((F.col("rank") <= k) & F.col("relevance").isNotNull(), F.col("score"))), F.lit(0.0)) - F.coalesce(F.avg(F.when((F.col("rank") <= k) & F.col("relevance").isNull(), F.col("score"))), F.lit(0.0))).alias("gap"),
    )
    measured = metrics.ranking_metrics(ranked.where(F.col("rank") <= k), qrels, k, by=keys)
    rows = measured.join(reach, keys).join(relevant, "query_id").withColumn("candidate_recall", F.round(F.col("reached") / F.col("relevant"), 6))
    means = [F.round(F.avg(n), 6).alias(n) for n in OBJECTIVE]
    trials = objective(rows.groupBy("candidates", "ranking").agg(F.count("*").alias("queries"), *means))
    order = Window.orderBy(F.desc("composite"), F.desc("candidate_recall"), F.desc("ndcg"), "candidates", "ranking")  # a row a trial
    return trials.withColumn("place", F.row_number().over(order))
