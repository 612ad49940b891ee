"""Source trust and committee votes as column expressions over a table of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of

# What each domain values (peer review, preregistration, archival provenance, open method) and its citation half-life in years.
DOMAINS = {
    "general_academic": (True, True, False, True, 8),
    "economics": (True, True, False, True, 7),
    "psychology": (True, True, False, True, 6),
    "anthropology": (True, False, True, True, 12),
    "history": (True, False, True, False, 16),
    "cultural_studies": (True, False, True, False, 14),
    "legal_market": (False, False, True, True, 5),
    "public_opinion": (False, False, True, False, 2),
}

# Weights of the trust components and the least score of each tier.
TRUST_WEIGHTS = {"bibliographic_provenance": 0.2, "publication_channel": 0.25, "reporting_transparency": 0.25, "open_science": 0.15, "field_normalized_influence": 0.15}
TIERS = [("strong", 0.75), ("moderate", 0.55), ("limited", 0.35)]


def gain(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def filled(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) != ""


def source_trust(works: DataFrame, domain: str = "general_academic", newest: int = 2026) -> DataFrame:
    """Add the trust components, ``source_trust`` and ``trust_tier``.

    ``works`` has ``doi, source_name, landing_page_url, year, source_type, abstract, referenced_work_count, cited_by_count, is_retracted``.
    """
    peer, registered, archival, method, half_life = DOMAINS.get(domain, DOMAINS["general_academic"])
    kind, text = F.lower(F.coalesce("source_type", F.lit(""))), F.col("abstract")
    references, cited = F.coalesce("referenced_work_count", F.lit(0)), F.coalesce("cited_by_count", F.lit(0))
    age = F.greatest(F.lit(1), newest - F.coalesce("year", F.lit(newest)) + 1)
    channel = (
        F.when(F.col("is_retracted"), 0.0)
        .when(kind.isin("journal", "book", "conference"), 0.8 if peer else 0.65)
        .when(kind.isin("repository", "preprint"), 0.45)
        .when(kind.isin("report", "dataset"), 0.65 if archival else 0.5)
        .when(kind.isin("social_media", "social_media_post", "forum", "forum_comment", "comment"), 0.25)
        .when(filled("source_name"), 0.55)
        .otherwise(0.25)
    )
    reporting = F.when(references >= 20, 0.25).when(references > 0, 0.15).otherwise(0.0)
    reporting = reporting + gain(any_of(text, ["data", "sample", "method", "model", "archive"]), 0.2) + gain(any_of(text, ["robustness", "sensitivity", "replication"]), 0.2) + gain(any_of(text, ["limitation", "uncertainty", "bias"]), 0.15)
    openness = gain(any_of(text, ["preregister", "pre-register", "registered report"]), 0.35 if registered else 0.15) + gain(any_of(text, ["data available", "replication data", "open data"]), 0.25) + gain(any_of(text, ["code available", "github", "osf", "dataverse"]), 0.2)
    parts = {
        "bibliographic_provenance": gain(filled("doi"), 0.45) + gain(filled("source_name"), 0.25) + gain(filled("landing_page_url"), 0.15) + gain(F.coalesce("year", F.lit(0)) > 0, 0.15),
        "publication_channel": channel,
        "reporting_transparency": reporting + (0.1 if method else 0.0),
        "open_science": openness,
        "field_normalized_influence": F.when(cited <= 0, 0.0).otherwise(cited / (12.0 * F.least(age, F.lit(half_life)))),
    }
    rows = works.withColumns({n: F.least(F.lit(1.0), c) for n, c in parts.items()})
    score = sum((F.col(n) * w for n, w in TRUST_WEIGHTS.items()), F.lit(0.0)) / sum(TRUST_WEIGHTS.values())
    rows = rows.withColumn("source_trust", F.when(F.col("is_retracted"), 0.0).otherwise(F.round(score, 6)))
    tier = F.when(F.col("is_retracted"), "blocked")
    for name, least in TIERS:
        tier = tier.when(F.col("source_trust") >= least, name)
    return rows.withColumn("trust_tier", tier.otherwise("low"))


def committee(rows: DataFrame) -> DataFrame:
    """Add the six votes, ``committee_decision`` and ``allowed_uses``.

    ``rows`` has ``candidate_score, lexical, semantic, syntax, source_trust, is_retracted, domain_fit_tier, safety_decision,
    corroboration_verdict, is_public_opinion``; the verdict is one for a whole candidate set.
    """
    c = F.col
    unsafe = c("safety_decision").isin("block", "quarantine")
    votes = {
        "vote_relevance": F.when((c("candidate_score") >= 0.55) | (c("lexical") >= 0.5) | (c("semantic") >= 0.65), "approve").when((c("candidate_score") >= 0.25) | (c("lexical") >= 0.2) | (c("semantic") >= 0.35) | (c("syntax") >= 0.7), "caution").otherwise("reject"),
        "vote_trust": F.when(c("is_retracted"), "reject").when(c("source_trust") >= 0.55, "approve").otherwise("caution"),
        "vote_domain": F.when(c("domain_fit_tier").isin("blocked", "quarantine_review"), "reject").when(c("domain_fit_tier").isin("strong_fit", "moderate_fit"), "approve").otherwise("caution"),
        "vote_safety": F.when(unsafe, "reject").when(c("safety_decision") == "sanitize", "caution").otherwise("approve"),
        "vote_corroboration": F.when(c("corroboration_verdict") == "independently_corroborated", "approve").otherwise("caution"),
        "vote_opinion": F.when(~c("is_public_opinion"), "not_applicable").when(unsafe, "reject").otherwise("caution"),
    }
    rows = rows.withColumns(votes)
    cautions = sum(((c(v) == "caution").cast("int") for v in votes), F.lit(0))
    decision = (
        F.when((c("vote_safety") == "reject") | (c("vote_trust") == "reject"), "reject")
        .when(c("vote_relevance") == "reject", "inspect_only")
        .when(c("vote_opinion") == "caution", "aggregate_only")
        .when(c("vote_domain") == "reject", "quarantine_review")
        .when(cautions >= 2, "use_with_caution")
        .otherwise("use_as_context")
    )
    rows = rows.withColumn("committee_decision", decision)
    uses = F.array_compact(F.array(F.lit("audit"), F.when(c("committee_decision").isin("use_as_context", "use_with_caution"), "generator_context"), F.when(c("committee_decision") == "aggregate_only", "aggregate_public_opinion"), F.when(c("vote_safety") == "caution", "sanitized_context_only")))
    return rows.withColumn("allowed_uses", F.array_join(uses, ","))
