"""Document types, their traits, and how well works fit a domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_profiles as P
from ..functions.text import any_of


def document_type(works: DataFrame) -> DataFrame:
    """Add ``document_type`` and its traits.

    ``works`` has ``title, source_name, abstract, landing_page_url, doi, referenced_work_count, source_type, provenance``; a work
    takes the first type whose source types or substrings it has.
    """
    kind = F.lower(F.trim(F.coalesce("source_type", F.lit(""))))
    hay = F.concat_ws(" ", *[F.lower(F.col(c)) for c in ("title", "source_name", "abstract", "landing_page_url", "source_type", "provenance")])
    works = works.withColumn("_hay", hay)
    also = {
        "policy_report": kind.isin("report", "dataset") & any_of(F.col("_hay"), P.INSTITUTIONS),
        "academic_article": (F.coalesce("doi", F.lit("")) != "") | (F.coalesce("referenced_work_count", F.lit(0)) >= 10),
        "web_page": (F.coalesce("provenance", F.lit("")) == "web") | (F.coalesce("landing_page_url", F.lit("")) != ""),
    }
    found = F.lit(None).cast("string")
    for name, kinds, markers in P.TYPE_RULES:
        holds = also.get(name, F.lit(False)) | kind.isin(kinds) if kinds else also.get(name, F.lit(False))
        found = F.coalesce(found, F.when(holds | any_of(F.col("_hay"), markers) if markers else holds, name))
    works = works.withColumn("document_type", F.coalesce(found, F.lit("unknown_unstructured_text"))).drop("_hay")
    traits = F.create_map(*[x for name, values in P.TYPE_TRAITS.items() for x in (F.lit(name), F.struct(*[F.lit(v).alias(n) for n, v in zip(P.TRAIT_NAMES, values, strict=True)]))])
    return works.withColumn("_t", F.element_at(traits, F.col("document_type"))).select(*works.columns, "_t.*")


def gate_flags(domain: str) -> Column:
    """The reasons, as an array, for which a work with its type's traits is held back in ``domain``."""
    c = F.col
    kind, provenance = c("document_type"), F.lower(F.coalesce("provenance", F.lit("")))
    flags = {
        "integrity_gate_failed": c("is_retracted"),
        "missing_document_type": kind == "unknown_unstructured_text",
        "high_adversarial_surface": (c("adversarial_surface") >= 0.7) & F.lit(domain != "public_opinion"),
        "weak_authority_for_authority_domain": F.lit(domain == "legal_market") & kind.isin("legal_authority", "regulatory_filing") & (c("authority_signal") < 0.6),
        "weak_primary_source_provenance": F.lit(domain in ("history", "anthropology")) & kind.isin("archival_primary_source", "transcript") & ~provenance.isin("archive", "official", "academic"),
    }
    if domain == "public_opinion":
        flags["missing_public_visibility"] = ~F.lower(F.coalesce("visibility", F.lit(""))).isin("public", "public_web", "open")
        flags["missing_platform_context"] = F.trim(F.coalesce("platform", F.lit(""))) == ""
        flags["aggregation_required"] = kind.isin("social_media_post", "forum_comment")
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in flags.items()]))


def domain_fit(works: DataFrame, domain: str) -> DataFrame:
    """Add ``domain_gate_flags, domain_fit_score, domain_fit_tier`` to works with type traits and trust components."""
    types, families = P.DOMAIN_PREFERENCES.get(domain, P.DOMAIN_PREFERENCES["general_academic"])
    weights = P.FIT_WEIGHTS["history"] if domain in P.SHARES_HISTORY_WEIGHTS else P.FIT_WEIGHTS.get(domain, P.FIT_WEIGHTS[""])
    c = F.col
    parts = {
        "document_type_fit": F.when(c("document_type").isin(types), 1.0).when(c("document_type") == "unknown_unstructured_text", 0.25).otherwise(0.45),
        "evidence_family_fit": F.when(c("evidence_family").isin(families), 1.0).when(c("evidence_family") == "unknown", 0.35).otherwise(0.55),
        "authority_fit": c("authority_signal"),
        "transparency_fit": c("reporting_transparency"),
        "provenance_fit": c("bibliographic_provenance"),
        "publication_channel_fit": c("publication_channel"),
        "open_science_fit": c("open_science"),
        "safety_fit": F.greatest(F.lit(0.0), 1.0 - F.greatest(c("adversarial_surface"), c("source_intent_risk") * 0.8)),
    }
    works = works.withColumn("domain_gate_flags", gate_flags(domain))
    adversarial = F.array_contains("domain_gate_flags", "high_adversarial_surface")
    failed = F.array_contains("domain_gate_flags", "integrity_gate_failed")
    penalty = 0.08 * (F.size("domain_gate_flags") - adversarial.cast("int")) + F.when(adversarial, 0.18).otherwise(0.0)
    base = sum((parts[n] * w for n, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    works = works.withColumn("domain_fit_score", F.when(failed, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty)), 6)))
    tier = F.when(failed, "blocked").when(adversarial & (c("domain_fit_score") < 0.5), "quarantine_review")
    for name, least in P.FIT_TIERS:
        tier = tier.when(c("domain_fit_score") >= least, name)
    return works.withColumn("domain_fit_tier", tier.otherwise("low_fit"))
