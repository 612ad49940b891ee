"""Vector and score functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(usable, dot(a, b) / norms).otherwise(0.0)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """0 to 1 between the bounds; a constant gives 1 if it is positive, else 0."""
    return F.when(high > low, (value - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.when(value > 0, 1.0).otherwise(0.0))


def recency(year: Column, newest: int = 2026, half_life: float = 12.0) -> Column:
    age = F.greatest(F.lit(0), F.lit(newest) - year)
    return F.when(year.isNull(), 0.0).otherwise(F.round(F.pow(F.lit(0.5), age / half_life), 4))


def weighted(components: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the positive weights; components that are not there count 0."""
    total = sum(w for w in weights.values() if w > 0)
    parts = [F.coalesce(components[n], F.lit(0.0)) * w for n, w in weights.items() if n in components]
    return sum(parts[1:], parts[0]) / total if parts and total else F.lit(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
