"""Context packets: the role of each piece of evidence, and a selection that has something of every role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import corroboration, evidence

# The order in which roles are served, and what evidence of each may be used for.
ROLE_ORDER = ["direct_evidence", "method_detail", "limitation_or_caveat", "corroborating_source", "contradicting_source", "contextual_background"]
USES = {"contradicting_source": "use_for_conflict_or_caveat", "limitation_or_caveat": "use_for_limitations", "method_detail": "use_for_method_context"}
# Least signal that makes a caveat or a method, and least share of the query's words that makes evidence direct.
LEAST_SIGNAL, LEAST_OVERLAP = 0.35, 0.25


def conflict_linked(best: DataFrame) -> DataFrame:
    """``query_id, doc_id`` of the evidence whose claim opposes that of another document of the same query.

    ``best`` has one claim a document and query: ``query_id, doc_id, stance, topics``. Claims that share two topic tokens meet in the groups of
    their pairs of tokens; a group keeps the outermost documents of either side only, which tells whether another document is on the other side.
    """
    topics = F.array_sort(F.array_distinct("topics"))
    pairs = F.flatten(F.transform(topics, lambda t, i: F.transform(F.slice(topics, i + 2, F.size(topics)), lambda u: F.struct(t.alias("t"), u.alias("u")))))
    keyed = best.where(F.col("stance").isin("supportive", "critical", "mixed") & (F.size(topics) >= 2)).select("query_id", "doc_id", (F.col("stance") == "supportive").alias("pro"), F.inline(pairs))
    ends = keyed.groupBy("query_id", "t", "u").agg(*[f(F.when(side, F.col("doc_id"))).alias(n) for side, a in ((F.col("pro"), "pro"), (~F.col("pro"), "con")) for f, n in ((F.min, f"{a}_low"), (F.max, f"{a}_high"))])
    both = keyed.join(ends.where("pro_low is not null and con_low is not null"), ["query_id", "t", "u"])
    low, high = F.when(F.col("pro"), F.col("con_low")).otherwise(F.col("pro_low")), F.when(F.col("pro"), F.col("con_high")).otherwise(F.col("pro_high"))
    return both.where((low != F.col("doc_id")) | (high != F.col("doc_id"))).select("query_id", "doc_id").distinct()


def corroborated(keyed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``query_id, doc_id`` of the documents with a claim that several independent sources of the query make."""
    good = verdicts.where("verdict = 'independently_corroborated'").select("query_id", "claim_key")
    return keyed.join(good, ["query_id", "claim_key"], "left_semi").select("query_id", "doc_id").distinct()


def role() -> Column:
    """From ``stance, linked, limitation_signal, method_signal, corroborating, overlap, relevance``."""
    return (
        F.when((F.col("stance") == "critical") | F.col("linked"), "contradicting_source").when(F.col("limitation_signal") >= LEAST_SIGNAL, "limitation_or_caveat").when(F.col("method_signal") >= LEAST_SIGNAL, "method_detail")
        .when(F.col("corroborating"), "corroborating_source").when((F.col("overlap") >= LEAST_OVERLAP) | (F.col("relevance") > 0), "direct_evidence").otherwise("contextual_background")
    )


def packets(rows: DataFrame, claims: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The packet of each query, and its corroboration summary.

    ``rows`` is the evidence (``query_id, doc_id, rank, score, relevance, overlap``, the signals, and ``safety_decision``); ``claims`` all claims
    of its documents with ``fingerprint`` and ``stance``. Blocked and quarantined evidence is left out and counted as ``excluded``. The best piece
    of each role comes first, in the order of the roles, then the best of the rest, ``most`` in all, with ``place, role, allowed_use``.
    """
    safe = rows.where(~F.col("safety_decision").isin("block", "quarantine"))
    mine = claims.join(safe.select("query_id", "doc_id"), "doc_id")
    keyed = mine.withColumn("claim_key", corroboration.claim_key(F.col("_tokens"))).where("claim_key <> ''")
    verdicts = corroboration.grouped(keyed, ["query_id", "claim_key"])
    surest = claims.groupBy("doc_id").agg(F.min_by(F.struct("stance", evidence.topic_tokens(F.col("_tokens")).alias("topics")), F.struct((-F.col("confidence")).alias("c"), "position")).alias("b"))
    best = safe.select("query_id", "doc_id").join(surest, "doc_id").select("query_id", "doc_id", "b.*")
    mark = lambda df, n: df.withColumn(n, F.lit(True))
    each = safe.join(best.select("query_id", "doc_id", "stance"), ["query_id", "doc_id"], "left").join(mark(conflict_linked(best), "linked"), ["query_id", "doc_id"], "left").join(mark(corroborated(keyed, verdicts), "corroborating"), ["query_id", "doc_id"], "left")
    each = each.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in ("linked", "corroborating")}).withColumn("role", role())
    better = [F.desc("score"), F.desc("relevance"), F.desc("evidence_specificity"), F.asc("rank")]
    first = (F.row_number().over(Window.partitionBy("query_id", "role").orderBy(*better)) == 1).cast("int")
    turn = F.array_position(F.array(*map(F.lit, ROLE_ORDER)), F.col("role"))
    placed = each.withColumn("_first", first).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_first"), F.when(F.col("_first") == 1, turn), *better)))
    use = F.lit("use_as_supporting_evidence")
    for name, value in USES.items():
        use = F.when(F.col("role") == name, value).otherwise(use)
    out = rows.groupBy("query_id").agg(F.count_if(F.col("safety_decision").isin("block", "quarantine")).alias("excluded"))
    packet = placed.where(F.col("place") <= most).join(out, "query_id").select("query_id", "doc_id", "place", "role", use.alias("allowed_use"), "excluded")
    return packet, corroboration.overall(verdicts, ["query_id"])
