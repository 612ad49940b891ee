"""Policy grids, successive halving and preference models against plain Python and numpy."""

import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import fixed_policies
from millrace.operators import preference, tuning

PARTS = ["relevance", "overlap", "claim_density"]


def candidates(spark, queries=6, docs=9):
    rows = [(q, d, d + 1, (d * 7 + q * 3) % 11 / 10, (d * 5 + q) % 7 / 6 if d % 4 else None, (d + q) % 3 / 2) for q in range(queries) for d in range(docs)]
    grades = [(q, d, float((d + q) % 3)) for q in range(queries) for d in range(docs) if (d + q) % 3]
    return rows, grades, spark.createDataFrame(rows, "query_id long, doc_id long, rank int, relevance double, overlap double, claim_density double"), spark.createDataFrame(grades, "query_id long, doc_id long, relevance double")


def ranked(rows, weights, k):
    total = sum(w for w in weights.values() if w > 0) or 1.0
    scored = [(-round(sum((x or 0.0) * weights.get(n, 0.0) for n, x in zip(PARTS, r[3:], strict=True)) / total, 6), r[1]) for r in rows]
    return [d for _, d in sorted(scored)[:k]]


def ndcg(listed, grades, k):
    gain = lambda g: 2**g - 1
    best = sum(gain(g) / math.log2(i + 2) for i, g in enumerate(sorted(grades.values(), reverse=True)[:k]))
    return round(sum(gain(grades.get(d, 0)) / math.log2(i + 2) for i, d in enumerate(listed)) / best, 6) if best else 0.0


def test_every_policy_ranks_as_by_hand(spark):
    rows, grades, table, qrels = candidates(spark)
    policies = tuning.simplex(PARTS, 4) | {"named": {"relevance": 1.0, "absent": 2.0, "overlap": -0.5}}
    got = {}
    for r in tuning.policy_runs(table, PARTS, policies, 4).orderBy("rank").collect():
        got.setdefault((r["policy"], r["query_id"]), []).append(r["doc_id"])
    for p, w in policies.items():
        for q in range(6):
            assert got[p, q] == ranked([r for r in rows if r[0] == q], w, 4), (p, q)
    each = {(r["policy"], r["query_id"]): r["ndcg"] for r in tuning.policy_metrics(tuning.policy_runs(table, PARTS, policies, 4), qrels, 4).collect()}
    for p, w in policies.items():
        for q in range(6):
            assert abs(each[p, q] - ndcg(got[p, q], {d: g for a, d, g in grades if a == q}, 4)) < 2e-6


def test_the_simplex_is_whole():
    grid = tuning.simplex(["a", "b", "c", "d", "e"], 5)
    assert len(grid) == 126 and all(abs(sum(w.values()) - 1) < 1e-9 for w in grid.values())
    assert set(fixed_policies.POLICIES) == set(fixed_policies.WEIGHTS) and len(fixed_policies.POLICIES) == 12


def test_one_policy_scan_a_grid_without_another_shuffle(spark):
    _, _, table, _ = candidates(spark)
    plan = tuning.policy_runs(table, PARTS, tuning.simplex(PARTS, 4), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_halving_measures_the_better_half_on_more_queries(spark):
    values = {(p, q): (p * 13 + q * 7) % 10 / 10 for p in range(9) for q in range(40)}
    table = spark.createDataFrame([(f"p{p}", q, v) for (p, q), v in values.items()], "policy string, query_id long, value double")
    folds = {r["q"]: r["f"] for r in spark.range(40).select(F.col("id").alias("q"), tuning.fold("id").alias("f")).collect()}
    asked = []

    def evaluate(policies, inside):
        asked.append(policies)
        return table.where(F.col("policy").isin(policies)).where(inside)

    got = tuning.successive_halving(evaluate, [f"p{p}" for p in range(9)], (2, 4, 8))
    alive, out = list(range(9)), []
    for rung, upto in enumerate((2, 4, 8), 1):
        mine = [q for q in range(40) if folds[q] < upto]
        mean = {p: sum(round(values[p, q] * 1_000_000) for q in mine) // len(mine) / 1_000_000 if mine else 0.0 for p in alive}
        order = sorted(alive, key=lambda p: (-mean[p], f"p{p}"))
        kept = order[: -(-len(order) // 2)] if rung < 3 else []
        out.insert(0, [(f"p{p}", rung, mean[p]) for p in order if p not in kept])
        alive = sorted(kept)
    assert [x[:3] for x in got] == [x for r in out for x in r] and [x[3] for x in got] == list(range(1, 10))
    assert [len(a) for a in asked] == [9, 5, 3]


def test_stage_grid_counts_what_the_sizes_reach(spark):
    rows, grades, table, qrels = candidates(spark)
    got = {(r["candidates"], r["ranking"]): r for r in tuning.stage_grid(table, {"first": -F.col("rank"), "overlap": F.coalesce("overlap", F.lit(0.0))}, [3, 9], qrels, 3).collect()}
    assert len(got) == 4 and sorted(r["place"] for r in got.values()) == [1, 2, 3, 4]
    for size in (3, 9):
        shares = [sum(1 for a, d, _ in grades if a == q and d < size) / sum(1 for a, _, _ in grades if a == q) for q in range(6)]
        assert abs(got[size, "first"]["candidate_recall"] - sum(shares) / 6) < 1e-5


def brute_ridge(x, y, penalty):
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    return mean, scale, np.linalg.solve(z.T @ z + penalty * np.diag([0.0] + [1.0] * x.shape[1]), z.T @ y)


def brute_folds(rows, penalty):
    """rows: (query, x, y); prediction of every row by the model of all other queries."""
    out = []
    for q, x, _ in rows:
        train = [r for r in rows if r[0] != q] or rows
        mean, scale, w = brute_ridge(np.array([r[1] for r in train]), np.array([r[2] for r in train]), penalty)
        out.append(min(1.0, max(0.0, w[0] + ((np.array(x) - mean) / scale) @ w[1:])))
    return out


def test_leaving_one_query_out_is_the_plain_refit(spark):
    rng = np.random.default_rng(2)
    rows = []
    for q in range(7):
        for p in range(5):
            x = [round(float(v), 3) for v in rng.random(3)] + [0.25]
            rows.append((q, f"p{p}", *x, round(float(0.6 * x[0] + 0.2 * x[1] + 0.1 * rng.random()), 3)))
    names = ["a", "b", "c", "constant"]
    got = {r["query_id"]: r for r in preference.fold_report(spark.createDataFrame(rows, "query_id long, policy string, a double, b double, c double, constant double, grade double"), names, "grade").collect()}
    flat = [(r[0], r[2:6], r[6]) for r in rows]
    predicted = brute_folds(flat, 0.75)
    doubles = []
    for q in range(7):
        mine = [r for r in rows if r[0] == q]
        for a, b in combinations(mine, 2):
            for left, right in ((a, b), (b, a)):
                if abs(round(left[6] - right[6], 9)) >= 0.025:
                    doubles.append((q, [u - v for u, v in zip(left[2:6], right[2:6], strict=True)], float(left[6] > right[6])))
    judged = brute_folds(doubles, 0.75)
    for q in range(7):
        errors = [p - y for p, (a, _, y) in zip(predicted, flat, strict=True) if a == q]
        assert abs(got[q]["mae"] - np.mean(np.abs(errors))) < 5e-5 and abs(got[q]["rmse"] - np.sqrt(np.mean(np.square(errors)))) < 5e-5 and got[q]["n"] == 5
        right = [(p >= 0.5) == (y >= 0.5) for p, (a, _, y) in zip(judged, doubles, strict=True) if a == q]
        assert got[q]["pairs"] == len(right) and abs(got[q]["pair_accuracy"] - np.mean(right)) < 1e-6


def test_one_query_and_none(spark):
    schema = "query_id long, policy string, a double, grade double"
    assert preference.fold_report(spark.createDataFrame([], schema), ["a"], "grade").count() == 0
    alone = preference.fold_report(spark.createDataFrame([(1, "x", 0.1, 0.5), (1, "y", 0.1, 0.5)], schema), ["a"], "grade").first()
    assert alone["n"] == 2 and alone["mae"] == 0.0 and alone["pairs"] is None
