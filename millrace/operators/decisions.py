"""What a policy makes of a candidate: weighted score, query controls, evidence decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_policies as fixed
from ..functions import text as T

SWITCHES = ["diversity", "relevance_floor", "low_relevance_penalty", "diversity_relevance_floor", "diversity_focus_floor", "method_signal_bonus", "limitation_signal_bonus", "evidence_specificity_bonus"]
BONUSES = ["method_signal", "limitation_signal", "evidence_specificity"]


def controls(queries: DataFrame) -> DataFrame:
    """``query_id, excluded, wants_disagreement, about_retraction`` of each query.

    Excluded are the words of four characters or more behind ``without``, ``except`` or the like, up to a word that ends the exclusion.
    """
    words = T.tokens(F.col("text"))
    state = F.aggregate(words, F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("over")), _exclude, lambda s: s["out"])
    plain = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), "\\s+"), lambda w: F.regexp_replace(w, "^[.,;:!?]+|[.,;:!?]+$", ""))
    return queries.select(
        "query_id", F.array_sort(F.array_distinct(state)).alias("excluded"), F.arrays_overlap(words, T.literals(fixed.DISAGREEMENT_TERMS)).alias("wants_disagreement"), F.arrays_overlap(plain, T.literals(fixed.RETRACTION_TERMS)).alias("about_retraction")
    )


def _exclude(s: Column, w: Column) -> Column:
    marks, ends = w.isin(fixed.EXCLUSION_MARKERS), w.isin(fixed.EXCLUSION_ENDS)
    takes = s["on"] & ~s["over"] & ~marks & ~ends & (F.char_length(w) >= 4)
    return F.struct((s["on"] | marks).alias("on"), F.when(takes, F.array_append(s["out"], w)).otherwise(s["out"]).alias("out"), (s["over"] | (s["on"] & ~marks & ends)).alias("over"))


def policy_rows(policies: dict[str, dict[str, float]]) -> Column:
    """The policies as an array of structs: name, weights in the order of the fixed parts, their positive sum, and the switches."""
    rows = []
    for name, weights in policies.items():
        own = [float(weights.get(p, 0.0)) for p in fixed.PARTS]
        switch = fixed.SWITCHES.get(name, {}) | {k: v for k, v in weights.items() if k in SWITCHES}
        rows.append(F.struct(F.lit(name).alias("policy"), F.array(*map(F.lit, own)).alias("w"), F.lit(sum(w for w in own if w > 0)).alias("total"), *[F.lit(float(switch.get(s, 0.0))).alias(s) for s in SWITCHES]))
    return F.array(*rows)


def decided(rows: DataFrame, policies: dict[str, dict[str, float]]) -> DataFrame:
    """Each candidate under each policy: ``policy, base_score, utility, decision, reasons, score`` and the policy's ``diversity`` and floors.

    ``rows`` has the components that there are (others count 0), ``decision`` (of the safety scan), ``excluded_share`` (of the query's
    excluded words that the text has), ``wants_disagreement``, ``about_retraction``, and maybe ``source_trust`` and ``is_retracted``.
    """
    has = set(rows.columns)
    part = {p: F.coalesce(F.col(p).cast("double"), F.lit(0.0)) if p in has else F.lit(0.0) for p in fixed.PARTS}
    each = rows.withColumnRenamed("decision", "safety_decision").withColumn("_p", F.explode(policy_rows(policies)))
    p = lambda n: F.col(f"_p.{n}")
    weighted = reduce(Column.__add__, [part[n] * F.element_at("_p.w", i + 1) for i, n in enumerate(fixed.PARTS) if n in has])
    base = F.when(p("total") > 0, weighted / p("total")).otherwise(0.0)
    floor, relevance = p("relevance_floor"), part["relevance"]
    below = (floor > 0) & (relevance < floor)
    base = base - F.lit(fixed.EXCLUSION_PENALTY) * F.coalesce("excluded_share", F.lit(0.0)) - F.when(below, p("low_relevance_penalty") * ((floor - relevance) / F.nullif(floor, F.lit(0.0)))).otherwise(0.0)
    each = each.withColumn("_base", F.greatest(F.lit(0.0), base))
    bonus = reduce(Column.__add__, [p(f"{n}_bonus") * part[n] for n in BONUSES])
    scale = F.least(F.lit(1.0), F.lit(fixed.GATE) + F.lit(1 - fixed.GATE) * F.greatest(relevance, part["semantic_similarity"]) + F.lit(fixed.TRUST_SHARE) * F.greatest(part["source_quality"], F.lit(fixed.TRUST_FLOOR)))
    utility = F.round((F.col("_base") + bonus) * scale, 6)
    trust = F.coalesce(F.col("source_trust"), F.lit(0.0)) if "source_trust" in has else part["source_quality"]
    gone = F.coalesce(F.col("is_retracted"), F.lit(False)) & ~F.col("about_retraction") if "is_retracted" in has else F.lit(False)
    unsafe = F.col("safety_decision").isin("block", "quarantine")
    sanitized, untrusted = F.col("safety_decision") == "sanitize", trust < fixed.LEAST_TRUST
    score = utility * F.when(sanitized, fixed.SANITIZED).otherwise(1.0) * F.when(untrusted, fixed.UNTRUSTED).otherwise(1.0) * F.when(below, fixed.BELOW_FLOOR).otherwise(1.0)
    reasons = F.array_compact(F.array(F.when(below, F.lit("below_relevance_floor")), F.when(sanitized, F.lit("safety_sanitize_penalty")), F.when(untrusted, F.lit("low_source_trust_penalty"))))
    named = F.when(unsafe, F.concat(F.lit("safety_"), F.col("safety_decision"))).when(gone, "integrity_gate_retracted").otherwise(F.array_join(reasons, ","))
    diversity = F.when(F.col("wants_disagreement"), F.greatest(p("diversity"), F.lit(fixed.DISAGREEMENT_DIVERSITY))).otherwise(p("diversity"))
    return each.select(
        *[c for c in each.columns if c not in ("_p", "_base")], p("policy").alias("policy"), F.round("_base", 6).alias("base_score"), utility.alias("utility"), F.when(unsafe | gone, "reject").otherwise("allow").alias("decision"), named.alias("reasons"),
        F.when(unsafe | gone, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), score), 6)).alias("score"), diversity.alias("diversity"), p("diversity_relevance_floor").alias("diversity_relevance_floor"), p("diversity_focus_floor").alias("diversity_focus_floor"),
    )
