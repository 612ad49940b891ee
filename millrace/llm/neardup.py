"""Near-duplicate documents by a Hamming join over b-bit MinHash signatures (operator 6).

A document's set holds its distinct shingles of five words (A-Z lower-cased). Documents with
equal sets collapse first. A signature has 64 symbols of 16 bits; two sets with Jaccard similarity J
agree in each symbol with probability J. Signatures that differ in at most ``max_distance`` symbols
must, by pigeonhole, have one of half as many chunks (and one more) with at most one error, and every single error in a chunk
is enumerated by leaving one symbol out: 64 keys a signature find all such pairs. The distance follows from
the least similarity: a pair just at it differs in more symbols with a probability of ``MAX_MISS`` at most.
At 0.85 (operator 6) that is a distance of 20 with 11 chunks, at 0.80 (the pipeline's stage) 24 with 13.
Every link is confirmed on the full sets.

Components need no pair of documents that are connected already, so keys are searched in rounds: each
document against the least of its keys' least members, then what is left apart against the greatest.
The documents of keys that still hold several components are joined once more by their sets'
rarest shingles (``prefixes``), which misses no link between them. So a large group of copies makes
pairs in proportion to its size, and no link between different components escapes.

Defined cases: null and wordless texts have no set and no links; with fewer than five words
the whole sequence is the one shingle; rows that repeat a doc_id count as one document; a
null doc_id joins its class, whose id is the least doc_id in it (null if all are null), and is kept only
if that is null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Numbering
from .common import frugal, join_small, materialise
from .components import connected_components
from .prefixes import bitmap, prefix_pairs

SHINGLE_WORDS = 5
MIN_PERCENT = 85
SYMBOLS = 64
MAX_MISS = 0.0004
CACHE_WORDS = 250_000

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
MULTIPLIERS = _RANDOM.integers(0, 2**64, SYMBOLS, np.uint64) | np.uint64(1)
ADDENDS = _RANDOM.integers(0, 2**64, SYMBOLS, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int):
        self.width = width
        self.words, self.hashes = Numbering(), np.zeros(0, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if len(self.words) > CACHE_WORDS:
            self.words, self.hashes = Numbering(), np.zeros(0, np.uint64)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if fresh := self.words.fresh:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))])
            self.words.fresh = []
        h = self.hashes[at]
        if not len(h):
            return h
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            out = out * _P + h[k : len(h) - n + 1 + k]
        return np.unique(mix(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * MULTIPLIERS + ADDENDS).min(0), out=least)
    return (mix(least) >> np.uint64(48)).astype("<u2")


def signatures(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_key, signature``; the last two are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sizes, keys, signs = [], [], []
            for text in batch.column(2):
                hashes = shingle(text.as_py())
                sizes.append(len(hashes))
                keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                signs.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_key", "signature"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(frugal(sign), "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary")


def max_distance(percent: int) -> int:
    """The least distance that a pair at this similarity exceeds with a probability of ``MAX_MISS`` at most."""
    differ, beyond = 1 - percent / 100, 1.0
    for d in range(SYMBOLS + 1):
        beyond -= comb(SYMBOLS, d) * differ**d * (1 - differ) ** (SYMBOLS - d)
        if beyond <= MAX_MISS:
            return d
    return SYMBOLS


def error_keys(signs: np.ndarray, chunks: int) -> np.ndarray:
    """For each signature (rows of symbols) its 64 keys: its chunks with each one symbol left out."""
    keys = np.empty(signs.shape, np.uint64)
    salted = mix((signs.astype(np.uint64) << np.uint64(8)) + np.arange(SYMBOLS, dtype=np.uint64) + np.uint64(1))
    chunk_of = np.sort(np.arange(SYMBOLS) % chunks)
    for chunk in range(chunks):
        at = np.flatnonzero(chunk_of == chunk)
        keys[:, at] = salted[:, at].sum(1, dtype=np.uint64)[:, None] - salted[:, at]
    return mix(keys + np.arange(SYMBOLS, dtype=np.uint64) * _P).astype(np.int64)


def key_rows(sets: DataFrame, percent: int) -> DataFrame:
    chunks = max_distance(percent) // 2 + 1

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                signs = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS)
                nodes = np.repeat(part.column(0).to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(error_keys(signs, chunks).ravel()), pa.array(nodes)], ["key", "node"])

    return sets.select("node", "signature").mapInArrow(frugal(expand), "key long, node long")


def near_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose sizes allow a link and whose signatures are near enough."""
    left = sets.select(F.col("node").alias("u"), F.col("n_shingles").alias("nu"), F.col("signature").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("n_shingles").alias("nv"), F.col("signature").alias("sv"))
    both = pairs.join(left, "u").join(right, "v").where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    most = max_distance(percent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SYMBOLS) for c in ("su", "sv"))
                yield batch.select(["u", "v"]).filter(pa.array((a != b).sum(1) <= most))

    return both.select("u", "v", "su", "sv").mapInArrow(frugal(keep), "u long, v long")


def full_sets(nodes: DataFrame, docs: DataFrame, width: int, with_bits: bool = False) -> DataFrame:
    """``node, tokens`` of each of the ``nodes``: the hashes of all its shingles; ``with_bits`` adds their bitmap ``bits``."""
    names = ["node", "tokens", "bits"][: 2 + with_bits]

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle(t.as_py()).view(np.int64) for t in part.column(1)]
                columns = [part.column(0), pa.array(sets, pa.list_(pa.int64()))]
                if with_bits:
                    columns.append(pa.array(list(map(bitmap, sets)), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    wanted = materialise(nodes.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    texts = join_small(docs.select(F.col("doc_id").cast("long"), "text"), wanted, ["doc_id"], "left_semi")
    return texts.mapInArrow(frugal(hash_sets), "node long, tokens array<long>" + (", bits array<long>" if with_bits else ""))


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of a written table that are links on the full sets."""
    full = materialise(full_sets(pairs.select(F.col("u").alias("node")).union(pairs.select("v")), docs, width), "sets")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left = full.select(F.col("node").alias("u"), F.col("tokens").alias("x"))
    right = full.select(F.col("node").alias("v"), F.col("tokens").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(frugal(overlap), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """Operator 6: ``doc_id, n_shingles, component_id, kept`` for every document."""
    return classify(docs, width, MIN_PERCENT).drop("text_hash")


def keep_one(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = MIN_PERCENT) -> DataFrame:
    """``docs`` without the documents that are near copies of another with a smaller doc_id."""
    gone = materialise(classify(docs.select("doc_id", "text"), width, percent).where("not kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_k"), F.col("text_hash").alias("_h")).distinct(), "copies")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_k"), F.xxhash64("text").alias("_h"))
    return join_small(keyed, gone, ["_k", "_h"], "left_anti").select("_row.*")


def classify(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` with each text's hash."""
    signed = materialise(signatures(docs, width), "signed")
    sets = materialise(signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "distinct")
    keys = key_rows(sets, percent)
    ends = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    shared = materialise(keys.join(ends, "key"), "keys")
    tested = links = labels = None
    for pick in (F.min, F.max):
        stars = hub_pairs(shared, labels, pick)
        if tested is not None:
            stars = stars.join(tested, ["u", "v"], "left_anti")
        pairs = materialise(near_pairs(stars, sets, percent), "pairs")
        found = materialise(confirm(pairs, docs, width, percent), "links")
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        labels = materialise(connected_components(links), "labels")
        shared = materialise(_unsettled(shared, labels), "keys")
    left = full_sets(shared, docs, width, with_bits=True).join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.size("tokens").alias("size"), "tokens", "bits")
    rest = prefix_pairs(materialise(left, "left"), percent)
    pairs = materialise(rest.join(tested, ["u", "v"], "left_anti"), "pairs")
    found = confirm(pairs, docs, width, percent)
    labels = materialise(connected_components(links.union(found)), "labels")
    classes = sets.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("class_id"))
    rows = signed.join(classes, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def hub_pairs(shared: DataFrame, labels: DataFrame | None, pick) -> DataFrame:
    """For each node one pair, with the least or greatest of its keys' least or greatest members, if in another component."""
    hubs = shared.groupBy("key").agg(pick("node").alias("hub"))
    rows = shared.join(hubs, "key").where("node <> hub").select("node", "hub")
    if labels is not None:
        own = labels.select("node", F.col("component").alias("c"))
        other = labels.select(F.col("node").alias("hub"), F.col("component").alias("d"))
        rows = rows.join(own, "node", "left").join(other, "hub", "left").where("coalesce(c, node) <> coalesce(d, hub)")
    rows = rows.groupBy("node").agg(pick("hub").alias("hub"))
    return rows.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def _unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of keys with members in different components."""
    rows = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    return shared.join(apart, "key", "left_semi")
