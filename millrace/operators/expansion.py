"""Query expansion by terms that stand together, diagnostics of queries, and candidate pools over a window.

Related terms are counted over all documents: pairs of a query term and another term of the same document, with what is too rare
pruned first. Counts of frequent pairs never leave a task one by one, and rare pairs only where they can still matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.storage import materialise, small
from . import first_stage, retrieval


def term_set(text: Column, least: int = 4) -> Column:
    """The distinct tokens of at least ``least`` characters that are not numbers."""
    return F.filter(F.array_distinct(T.tokens(text)), lambda w: (F.char_length(w) >= least) & ~w.rlike("^[0-9]+$"))


def related_terms(queries: DataFrame, docs: DataFrame, most: int = 3, support: int = 3, common: float = 0.2, counted: int = 8192, block: int = 4096) -> DataFrame:
    """``term, other, together, weight, place``: for each query term the ``most`` other terms that stand closest to it.

    ``weight`` is the Dice coefficient of the two terms' documents, rounded to 6. Both have at least ``support`` documents in common, and
    the other term is in at most a share ``common`` of all documents. Ties go to the smaller term.

    The ``counted`` most frequent others are counted as a matrix within the tasks. Their weights bound the rest: a rarer other with d documents reaches at
    most 2 min(d, df) / (d + df), so it meets only the query terms whose list it may still enter. Query terms come in blocks of at most ``block``.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs  # a small table in one file would be one task
    sets = materialise(docs.select("doc_id", term_set(F.col("text")).alias("terms")), "terms")
    n_docs = docs.count()
    frequency = materialise(sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= support).withColumn("id", F.monotonically_increasing_id()), "frequency")
    asked = materialise(queries.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).distinct().join(frequency, "term"), "asked")
    others = frequency.where(F.col("df") <= F.lit(common) * n_docs)
    often = others.orderBy(F.desc("df"), "term").limit(counted).collect()
    rarer = others.where((F.col("df") < often[-1]["df"]) | ((F.col("df") == often[-1]["df"]) & (F.col("term") > often[-1]["term"]))) if len(often) == counted else None
    found = []
    for part in retrieval.blocks(asked, block):
        own = part.select("term", "df").collect()
        pairs = materialise(weighed(matrix_pairs(sets, own, often, most, support)), "pairs")
        if rarer is not None:
            pairs = pairs.unionByName(weighed(rarer_pairs(sets, own, often, rarer, bounds(pairs, own, most, often[-1]["df"]), support)))
        found.append(pairs)
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("weight"), "other"))
    return reduce(DataFrame.unionByName, found).withColumn("place", place).where(F.col("place") <= most).select("term", "other", "together", "weight", "place")


def dice(together: Column, df: Column, other_df: Column) -> Column:
    return F.round(2 * together / (df + other_df), 6)


def weighed(pairs: DataFrame) -> DataFrame:
    return pairs.select("term", "other", "together", dice(F.col("together"), F.col("df"), F.col("other_df")).alias("weight"))


def dealt(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The items of the lists in the first column, and the row of each."""
    lists = batch.column(0)
    return np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()


def places(items: pa.Array, names: pa.Array) -> np.ndarray:
    """Each item's place among ``names``; -1: none."""
    return pc.fill_null(pc.index_in(items, names), -1).to_numpy(zero_copy_only=False)


def hashed(items: pa.Array, width: int) -> np.ndarray:
    """Two columns for each item, one below ``width`` and one from there on, by a hash that is the same in every task."""
    own = pc.dictionary_encode(items)
    code = np.array([zlib.crc32(w.encode()) | zlib.adler32(w.encode()[::-1]) << 32 for w in own.dictionary.to_pylist()], np.uint64)
    code = (code * np.uint64(0x9E3779B97F4A7C15))[own.indices.to_numpy(zero_copy_only=False)]
    return np.stack([(code >> np.uint64(40)) % np.uint64(width), (code >> np.uint64(8)) % np.uint64(width) + np.uint64(width)]).astype(np.int64)


def summed(sets: DataFrame, terms: pa.Array, columns: Callable[[pa.Array], np.ndarray], width: int) -> DataFrame:
    """``own, met``: for each of ``terms`` that a task met, how often each of ``width`` columns stands in the same documents.

    ``columns`` gives items' columns as rows of an array, -1 for none. Documents are added up as products of matrices.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((len(terms), width), np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                row, items = dealt(batch.slice(at, 512))
                left, right = np.zeros((512, len(terms)), np.float32), np.zeros((512, width), np.float32)
                own = places(items, terms)
                left[row[own >= 0], own[own >= 0]] = 1
                for column in columns(items):
                    np.add.at(right, (row[column >= 0], column[column >= 0]), np.float32(1))
                for c in range(0, width, 1024):
                    met[:, c : c + 1024] += (left.T @ right[:, c : c + 1024]).astype(np.uint32)
        rows = np.flatnonzero(met.any(1))
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([met[r].tobytes() for r in some], pa.binary())], ["own", "met"])

    return sets.select("terms").mapInArrow(count, "own int, met binary")


def total(group: pa.Table) -> tuple[int, np.ndarray]:
    """The term of a group of ``summed``, and the sum of its rows."""
    return group.column("own")[0].as_py(), sum(np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in group.column("met"))


def matrix_pairs(sets: DataFrame, own: list[Row], often: list[Row], most: int, support: int) -> DataFrame:
    """``term, df, other, other_df, together`` of the rows ``own`` with the rows ``often``: those that may be among a term's ``most`` best."""
    terms, names = pa.array([r["term"] for r in own], pa.string()), pa.array([r["term"] for r in often], pa.string())
    term_df, other_df = np.array([r["df"] for r in own], np.int64), np.array([r["df"] for r in often], np.int64)

    def best(group: pa.Table) -> pa.Table:
        at, met = total(group)
        there = np.flatnonzero((met >= support) & ~pc.equal(names, terms[at]).to_numpy(zero_copy_only=False))
        share = 2 * met[there] / (term_df[at] + other_df[there])
        if len(there) > most:
            there = there[share >= np.partition(share, -most)[-most] - 2e-6]  # more than rounding can move
        fixed = [pa.array([terms[at].as_py()] * len(there), pa.string()), pa.array(np.full(len(there), term_df[at]))]
        return pa.Table.from_arrays([*fixed, names.take(pa.array(there)), pa.array(other_df[there]), pa.array(met[there])], ["term", "df", "other", "other_df", "together"])

    rows = summed(sets, terms, lambda items: places(items, names)[None], len(names))
    return rows.groupBy("own").applyInArrow(best, "term string, df long, other string, other_df long, together long")


def bounds(pairs: DataFrame, own: list[Row], most: int, rare_df: int) -> DataFrame:
    """``own`` (its number), ``term, df, least``: the weight of each term's ``most``-th pair so far, where an other of at most ``rare_df`` documents may reach it."""
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("weight")))
    last = pairs.withColumn("p", place).where(F.col("p") == most).select("term", F.col("weight").alias("least"))
    each = pairs.sparkSession.createDataFrame([(i, r["term"], r["df"]) for i, r in enumerate(own)], "own int, term string, df long")
    near = F.least(F.lit(rare_df), F.col("df"))
    return each.join(last, "term", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).where(dice(near, F.col("df"), near) >= F.col("least"))


def rarer_pairs(sets: DataFrame, own: list[Row], often: list[Row], rarer: DataFrame, able: DataFrame, support: int) -> DataFrame:
    """As ``matrix_pairs``, of the terms ``able`` with the others ``rarer``, as far as they may enter a term's list.

    Others share hashed columns, two each. What a term meets in a column is at least what it meets of any other there, so a column that
    does not reach what the term's ``least`` asks for holds none. Each other of a document takes along, as one list, the terms whose columns both do.
    """
    able = materialise(able, "able")
    open_ = able.select("own", "term", "df", "least").orderBy("own").collect()  # at most a block
    terms, names, numbers = pa.array([r["term"] for r in open_], pa.string()), pa.array([r["term"] for r in often], pa.string()), np.array([r["own"] for r in open_], np.int32)
    width = max(1, len(often))
    need = [max(support, math.ceil((r["least"] - 1e-6) * (r["df"] + support) / 2)) for r in open_]

    def columns(items: pa.Array) -> np.ndarray:
        return np.where(places(items, names) < 0, hashed(items, width), -1)

    def reached(group: pa.Table) -> pa.Table:
        at, met = total(group)
        return pa.Table.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(met >= need[at]).tobytes()], pa.binary())], ["own", "bits"])

    bits = np.zeros((len(open_), (2 * width + 7) // 8), np.uint8)
    for r in summed(sets, terms, columns, 2 * width).groupBy("own").applyInArrow(reached, "own int, bits binary").collect():
        bits[r["own"]] = np.frombuffer(r["bits"], np.uint8)
    sent = sets.sparkSession.sparkContext.broadcast(bits)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(sent.value, axis=1, count=2 * width).view(bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                row, items = dealt(batch.slice(at, 512))
                mine, column = places(items, terms), columns(items)
                ends, lists, others = np.searchsorted(row, np.arange(513)), [], []
                for start, end in zip(ends, ends[1:]):
                    a, b = mine[start:end][mine[start:end] >= 0], start + np.flatnonzero(column[0, start:end] >= 0)
                    for first in range(0, len(b), 1024):
                        some = b[first : first + 1024]
                        met = may[np.ix_(a, column[0, some])] & may[np.ix_(a, column[1, some])]
                        hit = np.flatnonzero(met.any(0))
                        others.append(some[hit])
                        lists += [numbers[a[met[:, i]]] for i in hit]
                if lists:
                    found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)), pa.array(np.concatenate(lists)))
                    yield pa.RecordBatch.from_arrays([items.take(pa.array(np.concatenate(others))), found], ["other", "own"])

    told = rarer.select("id", F.col("term").alias("other"), F.col("df").alias("other_df"))
    each = sets.select("terms").mapInArrow(meet, "other string, own array<int>").join(told, "other").select("id", "other", "other_df", F.explode("own").alias("own"))
    near = each.join(F.broadcast(able), "own").where((F.col("term") != F.col("other")) & (dice(F.least("df", "other_df"), F.col("df"), F.col("other_df")) >= F.col("least")))
    counted = near.groupBy("id", "other_df", "own").agg(F.count("*").alias("together")).where(F.col("together") >= support)
    reaching = counted.join(F.broadcast(able), "own").where(dice(F.col("together"), F.col("df"), F.col("other_df")) >= F.col("least"))
    return reaching.join(told.select("id", "other"), "id").select("term", "df", "other", "other_df", "together")


def expanded_queries(queries: DataFrame, related: DataFrame, most: int = 5, share: float = 0.5) -> DataFrame:
    """``query_id, term, weight``: a query's own terms by how often it has them, and its ``most`` best related terms by ``share`` of their weight.

    A term that is related to several terms of the query counts with its greatest weight.
    """
    own = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight"))
    near = own.select("query_id", "term").join(related.select("term", "other", F.col("weight").alias("w")), "term")
    fresh = near.groupBy("query_id", F.col("other").alias("term")).agg(F.max("w").alias("w")).join(own.select("query_id", "term"), ["query_id", "term"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "term"))
    kept = fresh.withColumn("p", place).where(F.col("p") <= most)
    return own.unionByName(kept.select("query_id", "term", F.round(F.col("w") * share, 6).alias("weight")))


def weighted_bm25(wanted: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """BM25 top ``k`` of queries that are given as weighted terms ``query_id, term, weight``."""
    tokens = retrieval.tokenised(docs)
    terms = wanted.select("term").distinct()
    words = tokens.select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    few = small(terms, retrieval.MAX_BROADCAST_TERMS)
    hits = words.join(F.broadcast(terms) if few else terms, "term", "left_semi").repartition("doc_id").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    size = retrieval.corpus_size(tokens).first()
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    tf, dl = F.col("tf"), F.col("dl")
    norm = tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * dl / F.lit(float(size["avg_dl"] or 1.0)))
    scored = hits.join(F.broadcast(frequency) if few else frequency, "term").select("term", "doc_id", (retrieval.idf(F.lit(size["n_docs"]), F.col("df")) * tf * (retrieval.K1 + 1) / norm).alias("s"))
    pairs = scored.join(F.broadcast(wanted) if small(wanted, retrieval.MAX_BROADCAST_TERMS) else wanted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("s") * F.col("weight")), 6).alias("score"))
    return retrieval.top_k(pairs.where("score > 0"), k).select("query_id", "doc_id", "score", "rank")


def diagnosed(queries: DataFrame, top: DataFrame, docs: DataFrame, related: DataFrame) -> DataFrame:
    """``query_id, matched, weak, suggested``: the query's terms that its first documents have (singular and plural alike), those they lack, and the related terms."""
    asked = queries.select("query_id", F.array_sort(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda w: F.char_length(w) >= 3))).alias("terms"))
    has = docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("has"))
    seen = top.select("query_id", "doc_id").join(has, "doc_id").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("has"))).alias("has"))
    rows = asked.join(seen, "query_id", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    rows = rows.withColumn("_matched", F.filter("terms", lambda w: T.term_matches(w, F.col("has"))))
    offered = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).join(related, "term").groupBy("query_id").agg(F.array_sort(F.collect_set("other")).alias("offered"))
    both = rows.join(offered, "query_id", "left").withColumn("offered", F.coalesce("offered", F.array().cast("array<string>")))
    listed = lambda c: F.array_join(c, ",")
    return both.select("query_id", listed(F.col("_matched")).alias("matched"), listed(F.array_except("terms", "_matched")).alias("weak"), listed(F.array_except("offered", "terms")).alias("suggested"))


def windowed_pool(queries: DataFrame, docs: DataFrame, window: int = 96, k: int = 50) -> DataFrame:
    """``query_id, doc_id, lexical, dense, score, rank``: hashed vectors of each query's first ``window`` documents by BM25 only, fused with their BM25 scores.

    Vectors are made once a document, whatever queries it is a candidate of; a dense list holds a query's ``k`` nearest of its window.
    """
    lexical = materialise(retrieval.bm25_top_k(queries, docs, window), "window")
    wanted = docs.join(lexical.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    vectors = materialise(first_stage.hashed_vectors(wanted), "vectors")
    asked = first_stage.hashed_vectors(queries.select(F.col("query_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("query_id"), F.map_from_arrays("buckets", "weights").alias("q"))
    both = lexical.select("query_id", "doc_id", F.col("score").alias("lexical"), F.col("rank").alias("lexical_rank")).join(vectors, "doc_id").join(asked, "query_id")
    products = F.zip_with("buckets", "weights", lambda b, w: F.coalesce(F.element_at("q", b), F.lit(0.0)) * w)
    scored = both.withColumn("dense", F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), 6)).select("query_id", "doc_id", "lexical", "lexical_rank", "dense")
    near = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dense"), F.desc("doc_id")))
    scored = materialise(scored.withColumn("dense_rank", near), "scored")
    lists = [scored.where((F.col(f"{n}_rank") <= k) & (F.col(n) > 0)).select("query_id", "doc_id", F.col(n).alias("score")) for n in ("lexical", "dense")]
    fused = retrieval.weighted_fusion(*lists)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return fused.join(scored.select("query_id", "doc_id", "lexical", "dense"), ["query_id", "doc_id"]).withColumn("rank", rank)
