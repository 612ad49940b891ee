"""Benchmark decontamination by an FM-index of each training shard (operator 11).

A shard is a run of documents of one Spark task, ``SHARD_BYTES`` of text (a longer document is a shard of its own).
Its words are numbered by the vocabulary of the test phrases. A word that no phrase has can lie in no occurrence, so it
ends a run; runs of at least the shortest phrase's length are indexed, each with a terminator of its own. The index
is the Burrows-Wheeler transform of the runs as a wavelet matrix, with every ``SAMPLE``-th suffix position and every
start of a run kept. All phrases are searched backwards at once, one word a step; their rows walk to a sampled suffix; the
located words are merged into removal spans.

Phrases travel to the tasks in blocks of at most ``BLOCK_BYTES`` of text (one item alone may be longer), so that the
benchmark may have any size: each block is one pass over the documents, without a shuffle.

Defined cases: null texts and texts without words have no words and no hits. Items without words are ignored; items that
share an id count as one item; a null item_id counts as the empty id. Rows that repeat a document are reported each. Empty
tables give no rows, or no hits. Other columns are ignored (``remove_passages`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Words of a window; shorter items are one window.
WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
SAMPLE = 16
#: Bytes hashed at once; a longer word is hashed by itself.
PIECE = 1 << 20

_codes = np.arange(256)
IS_WORD = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x41) & (_codes <= 0x5A)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
LOWER = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Hasher:
    """64-bit polynomial hashes of byte ranges, the same wherever a range lies."""

    def __init__(self) -> None:
        self._grow(PIECE)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        k = 0
        while k < len(starts):
            first = starts[k]
            stop = max(k + 1, int(np.searchsorted(ends, first + PIECE, "right")))
            piece = data[first : ends[stop - 1]]
            if len(piece) >= len(self.up):
                self._grow(2 * len(piece))
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * self.up[: len(piece)], out=sums[1:])
            s, e = starts[k:stop] - first, ends[k:stop] - first
            out[k:stop] = (sums[e] - sums[s]) * self.down[s]
            k = stop
        return out


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the words of the texts ``data[bounds[i]:bounds[i + 1]]``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IS_WORD[data]
    # A text's first byte starts anew, whatever precedes it.
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Bits:
    """A packed bit vector that counts the ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: ranks of symbols in a sequence, one bit vector a bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(self.depth - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            zeros = symbols[~bits]
            self.levels.append((shift, Bits(bits), len(zeros)))
            symbols = np.concatenate([zeros, symbols[bits]])
        self.base = np.zeros(n_symbols, np.int64)
        self.base = self.rank(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at - self.base[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and how often each occurs before."""
        symbol = np.zeros(len(at), np.int64)
        for _, bits, zeros in self.levels:
            bit, ones = bits.get(at), bits.ones(at)
            at = np.where(bit, zeros + ones, at - ones)
            symbol = symbol << 1 | bit
        return symbol, at - self.base[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order; each 0 is a terminator, smaller than all else and than every later 0.

    Prefix doubling over what is not yet told apart: a suffix's rank is the first place of its group.
    """
    n = len(text)
    order = np.argsort(text.astype(np.uint16) if text.max() < 1 << 16 else text, kind="stable")
    codes = text[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (codes[1:] == 0)
    starts = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    alone = fresh & np.append(fresh[1:], True)
    open_, width = np.flatnonzero(~alone), 1
    while len(open_):
        at = order[open_]
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[open_] = at
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(fresh)
        rank[at] = np.repeat(open_[starts], np.diff(np.append(starts, len(key))))
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        width *= 2
    return order


class FmIndex:
    """Backward search and locating over a sequence of symbols from 1 to ``n_symbols - 1``; a 0 ends each run, the last too."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE) -> None:
        suffixes = suffix_array(text)
        before = text[suffixes - 1]  # of the first suffix: the last 0
        self.n = len(text)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.wavelet = Wavelet(before, n_symbols)
        kept = (suffixes % sample == 0) | (before == 0)
        self.marks, self.samples = Bits(kept), suffixes[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``[low, high)`` of each phrase; phrases stand at the right end of their rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - step]
            low[live] = self.smaller[c] + self.wavelet.rank(c, low[live])
            high[live] = self.smaller[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of the rows begin."""
        out, live, step = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(live):
            known = self.marks.get(rows)
            out[live[known]] = self.samples[self.marks.ones(rows[known])] + step
            live, rows = live[~known], rows[~known]
            c, rank = self.wavelet.access(rows)
            rows = self.smaller[c] + rank
            step += 1
        return out


class Phrases:
    """A block of items as distinct windows over their own vocabulary."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW) -> None:
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        bounds = np.cumsum([0, *map(len, raw)])
        starts, ends = word_bounds(data, bounds)
        flat = data.tobytes()
        numbers: dict[bytes, int] = {}
        codes = np.fromiter((numbers.setdefault(flat[s:e], len(numbers) + 1) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int32, len(starts))
        words = list(numbers)
        self.flat = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        self.word_ends = np.cumsum([0, *map(len, words)])  # of word c - 1: [c - 1, c]
        hashes = Hasher()(self.flat, self.word_ends[:-1], self.word_ends[1:]) if words else np.zeros(0, np.uint64)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        edges = np.searchsorted(starts, bounds)
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if a < b < a + window:
                row = np.zeros((1, window), np.int32)
                row[0, window - (b - a) :] = codes[a:b]
                rows.append(row)
            elif a < b:
                rows.append(np.lib.stride_tricks.sliding_window_view(codes[a:b], window))
            owners.append(np.full(len(rows[-1]) if a < b else 0, item))
        found = np.ascontiguousarray(np.concatenate(rows))
        # One row a distinct window, then the items of each window.
        _, first, inverse = np.unique(found.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
        self.rows = found[first].astype(np.int64)
        self.lengths = (self.rows > 0).sum(1)
        self.ids = sorted(set(ids))
        place = {x: k for k, x in enumerate(self.ids)}
        named = np.array([place[x] for x in ids], np.int64)
        pairs = np.unique(inverse.astype(np.int64) * max(1, len(self.ids)) + named[np.concatenate(owners)])
        self.window, self.items = np.divmod(pairs, max(1, len(self.ids)))
        self.item_ends = np.searchsorted(self.window, np.arange(len(self.rows) + 1))

    def __len__(self) -> int:
        return len(self.rows)

    def code(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher) -> np.ndarray:
        """Each word's number in the vocabulary, 0 for others (by hash; ``same`` settles it)."""
        at = np.searchsorted(self.hashes, h := hasher(data, starts, ends))
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, self.by_hash[at] + 1, 0)

    def same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether words equal those of their numbers, byte by byte."""
        own = self.word_ends[codes - 1]
        lengths = ends - starts
        same = lengths == self.word_ends[codes] - own
        live, k = np.flatnonzero(same), 0
        while len(live):
            live = live[lengths[live] > k]
            differs = data[starts[live] + k] != self.flat[own[live] + k]
            same[live[differs]] = False
            live, k = live[~differs], k + 1
        return same

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words in runs of vocabulary words that could hold a window: place, number, and whether a run ends there."""
        codes = self.code(data, starts, ends, hasher)
        checked = False
        while True:
            at = np.flatnonzero(codes)
            last = np.ones(len(at), bool)
            last[:-1] = (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])
            edges = np.append(0, np.flatnonzero(last) + 1)
            kept = np.repeat(np.diff(edges) >= self.lengths.min(), np.diff(edges))
            at, last = at[kept], last[kept]
            if checked:
                return at, codes[at], last
            wrong = at[~self.same(data, starts[at], ends[at], codes[at])]
            codes[wrong], checked = 0, True
            if not len(wrong):
                return at, codes[at], last


def search_shard(phrases: Phrases, data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words lie in an occurrence, and the items found in each document."""
    hit, found = np.zeros(len(starts), bool), {}
    if not len(phrases) or not len(starts):
        return hit, found
    doc = np.searchsorted(bounds, starts, "right") - 1
    at, codes, last = phrases.runs(data, starts, ends, doc, hasher)
    if not len(at):
        return hit, found
    present, small = np.unique(codes, return_inverse=True)
    renamed = np.zeros(len(phrases.word_ends), np.int64)
    renamed[present] = np.arange(1, len(present) + 1)
    # The runs one after the other, each with its terminator; where[] leads back to the word.
    place = np.arange(len(at)) + np.append(0, np.cumsum(last)[:-1])
    text = np.zeros(len(at) + int(last.sum()), np.int64)
    text[place] = small + 1
    where = np.zeros(len(text), np.int64)
    where[place] = at
    rows = renamed[phrases.rows]
    possible = np.flatnonzero((rows > 0).sum(1) == phrases.lengths)
    index = FmIndex(text, len(present) + 1)
    low, high = index.search(rows[possible], phrases.lengths[possible])
    n = high - low
    if not n.sum():
        return hit, found
    which = np.repeat(possible, n)
    located = index.locate(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    words = where[located]
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, words, 1)
    np.add.at(steps, words + phrases.lengths[which], -1)
    hit = np.cumsum(steps[:-1]) > 0
    for pair in np.unique(doc[words] * len(phrases) + which).tolist():
        d, w = divmod(pair, len(phrases))
        found.setdefault(d, set()).update(phrases.ids[i] for i in phrases.items[phrases.item_ends[w] : phrases.item_ends[w + 1]].tolist())
    return hit, found


def ranges(hit: np.ndarray) -> np.ndarray:
    """Merged ranges of set places: first, end, first, end, ..."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings and the bounds of its values (nulls: empty)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.Table]:
    """The rows of a task, in order, in tables of about ``shard_bytes`` of text (column 1)."""
    held, n = [], 0
    for batch in batches:
        _, bounds = _bytes(batch.column(1))
        first = 0
        while first < batch.num_rows:
            room = bounds[first] + shard_bytes - n
            stop = min(batch.num_rows, max(int(np.searchsorted(bounds, room, "right")) - 1, first + (not held)))
            if stop > first:
                held.append(batch.slice(first, stop - first))
                n += bounds[stop] - bounds[first]
                first = stop
            if first < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


CARRIED = pa.list_(pa.int64()), pa.list_(pa.string())
FINAL = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def _pass(phrases, first: bool, cut: bool | None, shard_bytes: int):
    """One pass of a block of phrases; ``cut`` None carries hits on, False reports them, True cuts them out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, block = Hasher(), phrases.value
        for shard in shards(batches, shard_bytes):
            data, bounds = _bytes(_whole(shard.column(1)))
            data = LOWER[data]
            starts, ends = word_bounds(data, bounds)
            edges = np.searchsorted(starts, bounds)
            hit, found = search_shard(block, data, bounds, starts, ends, hasher)
            columns = [_whole(c) for c in shard.columns]
            names = list(shard.schema.names)
            if not first:
                items, carried = columns.pop().to_pylist(), columns.pop().to_pylist()
                names = names[:-2]
                for d, spans in enumerate(carried):
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        hit[edges[d] + a : edges[d] + b] = True
                    if items[d]:
                        found.setdefault(d, set()).update(items[d])
            per_doc = np.diff(np.append(0, np.cumsum(hit))[edges])
            where = {d: ranges(hit[edges[d] : edges[d + 1]]) for d in np.flatnonzero(per_doc).tolist()}
            if cut is None:
                columns += [pa.array([where[d].tolist() if d in where else [] for d in range(shard.num_rows)], CARRIED[0]), pa.array([sorted(found.get(d, ())) for d in range(shard.num_rows)], CARRIED[1])]
                yield pa.RecordBatch.from_arrays(columns, [*names, "hits", "items"])
                continue
            # Code points before each byte, if anything was found.
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if where else None
            spans = {d: [(int(points[starts[edges[d] + a]] - points[bounds[d]]), int(points[ends[edges[d] + b - 1]] - points[bounds[d]])) for a, b in zip(r[::2].tolist(), r[1::2].tolist(), strict=True)] for d, r in where.items()}
            if cut:
                texts = columns[1].to_pylist()
                for d, found_spans in spans.items():
                    edge = [0, *(x for s in found_spans for x in s), len(texts[d])]
                    texts[d] = "".join(texts[d][a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                columns[1] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)
                continue
            items = [sorted(found.get(d, ())) for d in range(shard.num_rows)]
            report = [
                pa.array(np.diff(edges), pa.int64()), pa.array(per_doc, pa.int64()), pa.array(list(map(len, items)), pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array(per_doc > 0),
                pa.array([",".join(f"{a}:{b}" for a, b in spans.get(d, ())) for d in range(shard.num_rows)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([columns[0], *report], ["doc_id", *FINAL])

    return run


def phrase_blocks(spark: SparkSession, benchmark: DataFrame, block_bytes: int) -> Iterator[Phrases]:
    """The items in blocks of about ``block_bytes``, dealt by a hash of their ids; a block at a time reaches the driver."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k).collect()
        yield Phrases([r["id"] for r in rows], [r["t"] for r in rows])


def _search(rows: DataFrame, benchmark: DataFrame, cut: bool, shard_bytes: int, block_bytes: int) -> DataFrame:
    """``rows`` holds doc_id, text and, to be cut, the other columns as one struct, so that no names clash."""
    spark, first = rows.sparkSession, True
    fields, hits = rows.schema, T.StructType.fromDDL("hits array<bigint>, items array<string>")
    report = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
    blocks = phrase_blocks(spark, benchmark, block_bytes)
    block = next(blocks)
    for following in blocks:
        sent = spark.sparkContext.broadcast(block)
        rows = materialise(rows.mapInArrow(_pass(sent, first, None, shard_bytes), T.StructType([*fields.fields, *hits.fields])), "passages")
        block, first = following, False
    return rows.mapInArrow(_pass(spark.sparkContext.broadcast(block), first, cut, shard_bytes), fields if cut else report)


def find_passages(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Operator 11: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``spans``.

    ``spans`` are the merged removal spans, ``start:end`` in code points, comma-joined.
    """
    return _search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), benchmark, False, shard_bytes, block_bytes)


def remove_passages(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, with every occurrence of a window cut out of ``text``."""
    others = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rest = F.struct(F.lit(1).alias("c"), *(F.col(f"`{c}`").alias(own) for c, own in others.items())).alias("rest")
    found = _search(docs.select("doc_id", "text", rest), benchmark, True, shard_bytes, block_bytes)
    return found.select(*(F.col("rest").getField(others[c]).alias(c) if c in others else F.col(c) for c in docs.columns))
