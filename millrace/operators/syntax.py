"""Kinds of wording: what a query asks for, what a text offers, and how well they agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

CATEGORIES = list(fixed.SYNTAX_QUERY_TERMS)


def share_of(words: Column, terms: list[str], whole: float) -> Column:
    return F.least(F.lit(1.0), F.size(F.array_intersect(words, T.literals(terms))) / whole)


def query_targets(text: Column) -> Column:
    """The ten targets of a query, each from 0 to 1, as an array in the order of ``CATEGORIES``."""
    words, low = T.tokens(text), F.lower(F.coalesce(text, F.lit("")))
    raw = {c: share_of(words, terms, 3.0) for c, terms in fixed.SYNTAX_QUERY_TERMS.items()}
    for phrases, category, least in fixed.SYNTAX_QUERY_PHRASES:
        raw[category] = F.greatest(raw[category], F.when(T.any_of(low, phrases), least).otherwise(0.0))
    targets = F.transform(F.array(*[raw[c] for c in CATEGORIES]), lambda x: F.round(x, 6))
    general = F.array(*[F.lit(0.4 if c == "generic_claim" else 0.0) for c in CATEGORIES])
    return F.when(F.exists(targets, lambda x: x > 0), targets).otherwise(general)


def text_vector(text: Column, words: Column | None = None, low: Column | None = None) -> Column:
    """The ten values of a text, each from 0 to 1, as an array in the order of ``CATEGORIES``.

    ``words`` is a column of the text's distinct tokens and ``low`` of its lower-case form, null made empty, where there are such: each category
    reads them, so that they should not be expressions (``with_vector``).
    """
    words, raw = T.tokens(text) if words is None else words, F.coalesce(text, F.lit(""))
    low = F.lower(raw) if low is None else low
    signals = {name: T.marker_share(low, markers, by) for name, (markers, by) in fixed.SIGNAL_MARKERS.items()}
    values = {c: share_of(words, [*terms, *fixed.SYNTAX_DOCUMENT_TERMS[c]], 4.0) for c, terms in fixed.SYNTAX_QUERY_TERMS.items()}
    floors = {
        "method_detail": [signals["method_signal"]],
        "limitation_caveat": [signals["limitation_signal"], signals["uncertainty_signal"] * 0.8],
        "quantitative_result": [signals["evidence_specificity"], F.when(raw.rlike(fixed.QUANTITY), 0.8).otherwise(0.0)],
        "generic_claim": [signals["claim_density"]],
        "dialogue_or_transcript": [F.when(raw.rlike(fixed.SPEAKER), 0.85).otherwise(0.0)],
        "definition_or_taxonomy": [F.when(raw.rlike(fixed.DEFINITION), 0.85).otherwise(0.0)],
    }
    # Rounded one by one: a lambda over the array would have all of its expressions interpreted, each reading the text anew.
    return F.array(*[F.round(F.greatest(values[c], *floors[c]) if c in floors else values[c], 6) for c in CATEGORIES])


def with_vector(rows: DataFrame, text: str = "text", words: str | None = None) -> DataFrame:
    """Add ``vector``, the ``text_vector``; tokens (of the column ``words`` where there is one) and the lower-case form are made once a text."""
    own = F.array_distinct(T.tokens(F.col(text)) if words is None else F.col(words))
    made = rows.withColumns({"_own": own, "_low": F.lower(F.coalesce(F.col(text), F.lit("")))})
    return made.withColumn("vector", text_vector(F.col(text), F.col("_own"), F.col("_low"))).drop("_own", "_low")


def corpus_profile(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: ``counts`` of texts with at least 0.25 in each category, and ``weights`` by rarity, the largest 1."""
    counted = vectors.agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col(vector)[i] >= 0.25) for i in range(len(CATEGORIES))]).alias("counts"))
    raw = counted.withColumn("raw", F.transform("counts", lambda c: F.log((F.greatest(F.col("n"), F.lit(1)) + 1.0) / (c + 1.0)) + 1.0))
    return raw.select("n", "counts", F.transform("raw", lambda w: w / F.array_max("raw")).alias("weights"))


def primary_category(vector: Column) -> Column:
    """The category of the greatest value, by name where several have it; generic where all are 0."""
    named = F.transform(vector, lambda v, i: F.struct(v.alias("v"), F.get(T.literals(CATEGORIES), i).alias("c")))
    best = F.array_max(named)
    return F.when(best["v"] > 0, best["c"]).otherwise("generic_claim")
