"""Groups of claims that say the same, and how independent their sources are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.storage import materialise
from .clustering import similar_pairs

SUPPORTIVE = ["supportive", "descriptive", "mixed"]
NEAR = 0.72


def claim_key(words: Column) -> Column:
    """The first eight of the sorted distinct tokens of five characters or more, without words of the trade; may be empty."""
    return F.array_join(F.slice(F.sort_array(F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 5) & ~w.isin(fixed.CLAIM_KEY_STOP)))), 1, 8), " ")


def near_shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, repetition``: the share of a group's pairs of claims whose token sets are nearly equal.

    Equal sets are counted once with their number, so a group of copies makes no pairs; different sets of one group meet only
    by their rarest tokens (an exact prefix filter), so a common claim key is not compared with itself throughout. Groups of one set, which
    are most, have no other to meet: only the rest are taken apart into tokens, under a number instead of their key. ``rows`` has the sorted ``terms``.
    """
    sets = rows.groupBy(*by, "terms").agg(F.count("*").alias("m")).select(F.struct(*by).alias("by"), "terms", "m")
    sets = materialise(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    same = F.when(F.size("terms") > 0, F.expr("m * (m - 1) div 2")).otherwise(0).cast("long")
    blocks = sets.groupBy("by").agg(F.sum(same).alias("same"), F.sum("m").alias("n"), F.count("*").alias("sets"), F.min("id").alias("block"))
    blocks = materialise(blocks, "blocks")
    several = blocks.where("sets > 1").select("by", "block")
    met = materialise(sets.where("size(terms) > 0").join(several, "by").select("block", "id", "terms", "m"), "met")
    apart = similar_pairs(met, NEAR)
    many = met.select("block", F.col("id").alias("u"), F.col("m").alias("mu"))
    near = apart.join(many, ["block", "u"]).join(many.select("block", F.col("u").alias("v"), F.col("mu").alias("mv")), ["block", "v"]).groupBy("block").agg(F.sum(F.col("mu") * F.col("mv")).alias("near"))
    totals = blocks.join(near, "block", "left").withColumn("near", F.col("same") + F.coalesce("near", F.lit(0)))
    return totals.select("by.*", F.when(F.col("n") > 1, F.col("near") / F.expr("n * (n - 1) div 2")).otherwise(0.0).alias("repetition"))


def groups(found: DataFrame) -> DataFrame:
    """One row a claim key: supporting, independent, contradicting and echoing claims, the risk of an echo and the verdict.

    ``found`` has ``sentence, stance, _tokens, fingerprint``; the fingerprint names the source that a claim goes back to.
    """
    return grouped(found.withColumn("claim_key", claim_key(F.col("_tokens"))).where("claim_key <> ''"), ["claim_key"])


def by_query(keyed: DataFrame) -> DataFrame:
    """Each query's overall verdict over the groups of its own candidates' claims."""
    return overall(grouped(keyed, ["query_id", "claim_key"]), ["query_id"]).select("query_id", "overall_verdict")


def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    support = F.col("stance").isin(SUPPORTIVE)
    marked = T.any_of(F.col("sentence"), fixed.DEPENDENCE_MARKERS)
    narrow = rows.select(*by, F.sort_array(F.array_distinct("_tokens")).alias("terms"), F.when(support, F.col("fingerprint")).alias("source"), support.alias("supports"), (F.col("stance") == "critical").alias("against"), marked.cast("int").alias("marked"))
    # Written, as both the counts and the sets read it.
    narrow = materialise(narrow, "claims")
    counted = narrow.groupBy(*by).agg(F.count("*").alias("claims"), F.count_if("supports").alias("support"), F.countDistinct("source").alias("independent"), F.count_if("against").alias("contradictions"), F.avg("marked").alias("markers"))
    both = counted.join(near_shares(narrow, by), by).withColumn("echoes", F.col("support") - F.col("independent"))
    w = fixed.ECHO_WEIGHTS
    risk = F.col("echoes") / F.col("claims") * w["dependence"] + (1.0 - F.col("independent") / F.col("claims")) * w["concentration"] + F.col("repetition") * w["repetition"] + F.col("markers") * w["markers"]
    both = both.withColumn("echo_risk", F.round(F.least(F.lit(1.0), risk), 6))
    verdict = F.when((F.col("echo_risk") >= 0.45) & (F.col("independent") <= 1), "adversarial_echo_risk").when(F.col("contradictions") > 0, "conflicted").when(F.col("independent") >= 2, "independently_corroborated").when(F.col("independent") == 1, "single_source_or_dependent").otherwise("no_support")
    return both.select(*by, "claims", "support", "independent", "contradictions", "echoes", "echo_risk", verdict.alias("verdict"))


def overall(found: DataFrame, by: list[str]) -> DataFrame:
    """The groups' summary for each value of ``by``: largest independent support, sums, largest risk, overall verdict."""
    g = found.groupBy(*by).agg(F.count("*").alias("groups"), F.max("independent").alias("max_independent"), F.sum("support").alias("support"), F.sum("independent").alias("independent"), F.sum("contradictions").alias("contradictions"), F.max("echo_risk").alias("max_echo_risk"), F.max((F.col("verdict") == "adversarial_echo_risk").cast("int")).alias("_echo"))
    verdict = F.when(F.col("_echo") == 1, "adversarial_echo_risk").when(F.col("contradictions") > 0, "conflicted").when(F.col("max_independent") >= 2, "independently_corroborated").when(F.col("support") > 0, "single_source_or_dependent").otherwise("no_support")
    return g.withColumn("overall_verdict", verdict).drop("_echo")
