"""Stress on rankings: perturbed queries and their stability, slices of queries, and lists that keep each stance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

VARIANTS = ["capitals", "doubled", "first_half", "reversed", "thinned"]


def perturbed(queries: DataFrame) -> DataFrame:
    """``query_id, variant, text``: each query in capitals, twice over, cut in half, backwards, and without every third word.

    All but the first are made of the query's tokens. Order and case must not matter to a bag of words, repetition must not
    change the order of its list, and a shorter query shows how much of a list hangs on single words.
    """
    words = T.tokens(F.col("text"))
    made = {
        "capitals": F.upper(F.coalesce("text", F.lit(""))),
        "doubled": F.array_join(F.concat(words, words), " "),
        "first_half": F.array_join(F.slice(words, F.lit(1), F.ceil(F.size(words) / 2).cast("int")), " "),
        "reversed": F.array_join(F.reverse(words), " "),
        "thinned": F.array_join(F.filter(words, lambda w, i: i % 3 != 2), " "),
    }
    return queries.select("query_id", F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), made[n].alias("text")) for n in VARIANTS])))


def stability(base: DataFrame, runs: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, variant, overlap, same_first, mean_shift``: how much of the plain list each variant's keeps, and how far it moves.

    ``base`` has ``query_id, doc_id, rank``, ``runs`` a ``variant`` too. A query whose plain list is empty has no row; a variant that
    finds nothing of a list has overlap 0 and no shift.
    """
    plain = base.where(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("was"))
    sizes = plain.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("doc_id", "was").alias("first"))
    moved = runs.where(F.col("rank") <= k).join(plain, ["query_id", "doc_id"]).groupBy("query_id", "variant").agg(F.count("*").alias("kept"), F.avg(F.abs(F.col("rank") - F.col("was"))).alias("shift"))
    firsts = runs.where("rank = 1").select("query_id", "variant", F.col("doc_id").alias("now"))
    every = sizes.select("*", F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant"))
    both = every.join(moved, ["query_id", "variant"], "left").join(firsts, ["query_id", "variant"], "left")
    return both.select("query_id", "variant", F.round(F.coalesce("kept", F.lit(0)) / F.col("n"), 6).alias("overlap"), F.coalesce(F.col("first") == F.col("now"), F.lit(False)).alias("same_first"), F.round("shift", 6).alias("mean_shift"))


def sliced(queries: DataFrame, topics: dict[str, list[str]], long_words: int = 30) -> DataFrame:
    """``query_id, slice``: every query is in ``all``, in ``long`` or ``short``, and in each topic one of whose words it contains."""
    n = F.size(T.rough_tokens(F.col("text")))
    named = [F.lit("all"), F.when(n >= long_words, F.lit("long")).otherwise(F.lit("short")), *[F.when(T.any_of(F.col("text"), words), F.lit(f"topic_{name}")) for name, words in topics.items()]]
    return queries.select("query_id", F.explode(F.array_compact(F.array(*named))).alias("slice"))


def slice_boards(scores: DataFrame, slices: DataFrame, method: str = "policy", value: str = "ndcg", near: float = 0.01) -> DataFrame:
    """``slice, method, queries, mean, place, near_tie``: the methods' places in each slice; a near tie is at most ``near`` behind the one before.

    Values, which have six decimals, are summed in millionths, so that a mean halfway between two of them is rounded up whatever the order of addition.
    """
    total = F.sum(F.round(F.col(value) * 1_000_000).cast("long"))
    means = slices.join(scores, "query_id").groupBy("slice", method).agg(F.count("*").alias("queries"), F.round(total / (F.count(value) * 1_000_000), 6).alias("mean"))
    order = Window.partitionBy("slice").orderBy(F.desc("mean"), method)
    gap = F.round(F.lag("mean").over(order) - F.col("mean"), 6)
    return means.withColumns({"place": F.row_number().over(order), "near_tie": F.coalesce(gap <= near, F.lit(False))})


def preserving(candidates: DataFrame, k: int, floor: int, order: list[Column]) -> DataFrame:
    """The best ``k`` rows of each query of which every stance among its candidates has ``floor``, as far as it has as many.

    Adds ``place``. The ``floor`` best of each stance come first, by their own order, while there is room; what is left goes to the best of the
    rest. The order of ``order`` must be total within a query.
    """
    nth = F.row_number().over(Window.partitionBy("query_id", "stance").orderBy(*order))
    kept = candidates.withColumn("_owed", (nth <= floor).cast("int"))
    chosen = kept.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_owed"), *order))).where(F.col("_n") <= k)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("_n", "_owed")


def preservation(candidates: DataFrame, lists: DataFrame) -> DataFrame:
    """``query_id, stances, kept, preserved, contradiction_kept``: how many of the candidates' stances a list still has, and whether both sides of a dispute stay."""
    had = candidates.groupBy("query_id").agg(F.array_sort(F.collect_set("stance")).alias("had"))
    has = lists.groupBy("query_id").agg(F.array_sort(F.collect_set("stance")).alias("has"))
    both = had.join(has, "query_id", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    dispute = lambda c: F.array_contains(c, "supportive") & F.array_contains(c, "critical")
    share = F.size(F.array_intersect("had", "has")) / F.size("had")
    return both.select("query_id", F.size("had").alias("stances"), F.size("has").alias("kept"), F.round(share, 6).alias("preserved"), F.when(dispute("had"), dispute("has").cast("int")).otherwise(1).alias("contradiction_kept"))
