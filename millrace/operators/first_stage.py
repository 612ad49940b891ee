"""First-stage candidates: lexical, hashed-semantic, syntax and focus scores of all documents for many queries.

Texts are tokenised and hashed once, into a written table of words and sparse vectors. A group of at most ``GROUP`` queries, in matrices of
``BLOCK`` queries, is then answered by two scans of numbers: one for each query's least and greatest scores, one for the combined scores, of
which each task keeps a running best ``k``. No pair of query and document is shuffled but those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import text as X
from ..functions.storage import materialise
from . import retrieval, syntax

DIMENSIONS = 512
BLOCK = 256
#: Queries that one pair of scans answers; their matrices are broadcast.
GROUP = 4096
ROWS = 256
WEIGHTS = {"lexical": 0.45, "semantic": 0.3, "syntax": 0.1, "focus": 0.15}


@lru_cache(maxsize=500_000)
def bucket(feature: str, dimensions: int = DIMENSIONS) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big") % dimensions


def hashed_vector(words: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vector of hashed terms (weight 1) and neighbouring pairs (0.65) of at least three characters each."""
    long = [len(w) >= 3 for w in words]
    at = [bucket("tok:" + w, dimensions) for w, x in zip(words, long, strict=True) if x]
    singles = len(at)
    at += [bucket(f"bi:{a}_{b}", dimensions) for a, b, x, y in zip(words, words[1:], long, long[1:]) if x and y]
    weights = np.full(len(at), 0.65)
    weights[:singles] = 1.0
    out = np.bincount(np.array(at, np.int64), weights, dimensions)
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def _sparse(words: list[list[str]], dimensions: int) -> list[pa.Array]:
    vectors = [hashed_vector(w, dimensions) for w in words]
    at = [np.flatnonzero(v) for v in vectors]
    return [pa.array(at, pa.list_(pa.int64())), pa.array([v[i] for v, i in zip(vectors, at, strict=True)], pa.list_(pa.float64()))]


def with_hashed(tokens: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``tokens``, which has ``words``, with ``buckets, weights``: the non-zero entries of each hashed vector."""
    at = tokens.columns.index("words")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *_sparse(part.column(at).to_pylist(), dimensions)], [*part.schema.names, "buckets", "weights"])

    return tokens.mapInArrow(encode, T.StructType([*tokens.schema.fields, *T.StructType.fromDDL("buckets array<long>, weights array<double>").fields]))


def hashed_vectors(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, buckets, weights``: each text's hashed vector as its non-zero entries."""
    return with_hashed(docs.select("doc_id", X.tokens(F.col("text")).alias("words")), dimensions).drop("words")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def focus_terms(words: list[str]) -> list[str]:
    return sorted({w for w in words if len(w) >= 4 and w not in fixed.GENERIC_QUERY_TERMS})


class Block:
    """The queries of a block as matrices over their terms."""

    def __init__(self, rows: list, frequency: dict[str, int], n_docs: int, mean_length: float, rarity: list[float]):
        self.ids = [r["query_id"] for r in rows]
        self.terms = {t: i for i, t in enumerate(sorted({w for r in rows for w in r["words"]}))}
        self.known = pa.array(self.terms, pa.string())
        self.mean_length = mean_length
        self.idf = np.zeros((len(self.terms), len(rows)))
        self.focus = np.zeros((len(self.terms), len(rows)))
        for q, r in enumerate(rows):
            for w in r["words"]:
                df = frequency.get(w, 0)
                self.idf[self.terms[w], q] += np.log(1 + (n_docs - df + 0.5) / (df + 0.5)) if df else 0.0
            focus = focus_terms(r["words"])
            for w in focus:
                self.focus[self.terms[w], q] = 1.0 / len(focus)
        self.semantic = np.array([hashed_vector(r["words"]) for r in rows]).T
        targets = np.array([r["targets"] for r in rows])
        mass = targets.sum(1)
        self.syntax = (targets * (0.75 + 0.25 * np.array(rarity)) / np.where(mass > 0, mass, 1.0)[:, None]).T

    def scores(self, words: pa.ListArray, semantic: np.ndarray, vectors: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Matrices of documents times queries; ``semantic`` has the documents' hashed vectors as rows."""
        out = {n: np.zeros((len(words), len(self.ids))) for n in ("lexical", "focus")}
        lengths = np.diff(words.offsets.to_numpy())
        # All words of the batch are looked up at once; few of them are a query's.
        place = pc.fill_null(pc.index_in(words.flatten(), value_set=self.known), -1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(place >= 0)
        owner = np.repeat(np.arange(len(words)), lengths)[hit]
        docs, starts = np.unique(owner, return_index=True)
        for d, found in zip(docs.tolist(), np.split(place[hit], starts[1:]), strict=len(docs) > 0):
            at, tf = np.unique(found, return_counts=True)
            weight = tf * (retrieval.K1 + 1) / (tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * lengths[d] / self.mean_length))
            out["lexical"][d], out["focus"][d] = weight @ self.idf[at], self.focus[at].sum(0)
        out["semantic"] = semantic @ self.semantic
        if vectors is not None:
            out["syntax"] = np.round(np.clip(vectors @ self.syntax, 0, 1), 6)
        return out


def dense(part: pa.RecordBatch, buckets: str = "buckets", weights: str = "weights") -> np.ndarray:
    """The hashed vectors of a batch as rows."""
    out = np.zeros((part.num_rows, DIMENSIONS))
    lists = part.column(buckets)
    lengths = np.diff(lists.offsets.to_numpy())
    out[np.repeat(np.arange(part.num_rows), lengths), lists.flatten().to_numpy()] = part.column(weights).flatten().to_numpy()
    return out


def normal(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.where(high > low, (x - low) / np.where(high > low, high - low, 1.0), np.where(high > 0, 1.0, 0.0))


class Leading:
    """The best ``k`` rows of each query so far: by total, then lexical score, then the smaller id; with all their scores."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.keys = np.zeros((3, queries, k))
        self.keys[0] = -np.inf
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.scores = np.zeros((len(WEIGHTS), queries, k))

    def add(self, total: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``total`` and each of ``scores`` hold a row a query and a column a document."""
        rows = np.flatnonzero((total >= self.keys[0][:, -1:]).any(1))
        if not len(rows):
            return
        named = np.hstack([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
        both = np.hstack([self.keys[0][rows], total[rows]])
        lexical = np.hstack([self.keys[1][rows], scores[0][rows]])
        order = np.lexsort((named, -lexical, -both), axis=1)[:, : self.k]
        self.keys[0][rows], self.keys[1][rows] = np.take_along_axis(both, order, 1), np.take_along_axis(lexical, order, 1)
        self.ids[rows] = np.take_along_axis(named, order, 1)
        for i in range(len(WEIGHTS)):
            self.scores[i][rows] = np.take_along_axis(np.hstack([self.scores[i][rows], scores[i][rows]]), order, 1)


def group_candidates(rows: list, tokens: DataFrame, size, rarity: list[float], frequency: dict[str, int], k: int) -> DataFrame:
    """The candidates of a group of queries: two scans of the written ``doc_id, words, vector, buckets, weights``."""
    context = tokens.sparkSession.sparkContext
    sent = context.broadcast([Block(rows[at : at + BLOCK], frequency, size["n_docs"], size["avg_dl"] or 1.0, rarity) for at in range(0, len(rows), BLOCK)])

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for part in parts(batches):
            words, vectors = part.column("words"), dense(part)
            found = [block.scores(words, vectors) for block in sent.value]
            now = np.vstack([np.concatenate([f(s[n], axis=0) for s in found]) for n in ("lexical", "semantic") for f in (np.min, np.max)])
            seen = now if seen is None else np.vstack([f(seen[i], now[i]) for i, f in enumerate((np.minimum, np.maximum) * 2)])
        if seen is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(seen.shape[1])), *map(pa.array, seen)], ["q", "l0", "l1", "s0", "s1"])

    each = tokens.select("words", "buckets", "weights").mapInArrow(extremes, "q long, l0 double, l1 double, s0 double, s1 double")
    found = each.groupBy("q").agg(F.min("l0"), F.max("l1"), F.min("s0"), F.max("s1")).orderBy("q").collect()  # a row a query of the group
    bounds = np.array([tuple(r)[1:] for r in found]).reshape(-1, 4) if found else np.zeros((len(rows), 4))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        leading = [Leading(len(b.ids), k) for b in blocks]
        for part in parts(batches):
            ids, words = part.column("doc_id").to_numpy(), part.column("words")
            vectors, wording = dense(part), np.array(part.column("vector").to_pylist())
            first = 0
            for block, lead in zip(blocks, leading, strict=True):
                own = bounds[first : first + len(block.ids)]
                first += len(block.ids)
                s = block.scores(words, vectors, wording)
                s["lexical"], s["semantic"] = normal(s["lexical"], own[:, 0], own[:, 1]), normal(s["semantic"], own[:, 2], own[:, 3])
                lead.add(np.round(sum(s[n] * w for n, w in WEIGHTS.items()), 6).T, np.stack([s[n].T for n in WEIGHTS]), ids)
        for block, lead in zip(blocks, leading, strict=True):
            there = np.isfinite(lead.keys[0])
            names = np.repeat(np.array(block.ids, np.int64), there.sum(1))
            columns = [pa.array(names), pa.array(lead.ids[there]), pa.array(lead.keys[0][there]), *[pa.array(lead.scores[i][there]) for i in range(len(WEIGHTS))]]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "candidate_score", *WEIGHTS])

    made = tokens.select("doc_id", "words", "vector", "buckets", "weights").mapInArrow(best, "query_id long, doc_id long, candidate_score double, lexical double, semantic double, syntax double, focus double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("candidate_score"), F.desc("lexical"), "doc_id"))
    return made.withColumn("rank", rank).where(F.col("rank") <= k)


def first_stage(queries: DataFrame, docs: DataFrame, k: int = 50) -> DataFrame:
    """``query_id, doc_id, candidate_score, lexical, semantic, syntax, focus, rank`` of each query's best ``k`` of all documents.

    Ties go to the higher lexical score, then to the smaller id. ``query_id`` and ``doc_id`` are longs.
    """
    words = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text", X.tokens(F.col("text")).alias("words"))
    tokens = materialise(with_hashed(syntax.with_vector(words, words="words").select("doc_id", "words", "vector")), "tokens")
    size = tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("avg_dl")).first()
    rarity = syntax.corpus_profile(tokens).first()["weights"]
    found = []
    for part in retrieval.blocks(queries, GROUP):
        rows = part.select(F.col("query_id").cast("long"), X.tokens(F.col("text")).alias("words"), syntax.query_targets(F.col("text")).alias("targets")).orderBy("query_id").collect()
        wanted = tokens.sparkSession.createDataFrame([(w,) for w in sorted({w for r in rows for w in r["words"]})], "term string")
        hits = tokens.select(F.explode(F.array_distinct("words")).alias("term")).join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("df"))
        found.append(group_candidates(rows, tokens, size, rarity, {r["term"]: r["df"] for r in hits.collect()}, k))
    return reduce(DataFrame.unionAll, found)
