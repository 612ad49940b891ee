"""Packing token sequences of a fixed capacity (operators 1 and 10).

A packing plan depends only on how many pieces there are of each length, at most ``capacity`` numbers.
So Spark counts the lengths, the driver plans on that histogram alone, and every piece finds its place
by its rank among the pieces of its length. No piece list ever meets in one place, and a hot length
(a third of all rows, say) is ranked in salted groups.

Two plans are offered:

* ``exact_complement_plan``: each sequence begins with the longest length left; its gap is closed
  exactly by one, two or three available lengths (single, pair and triple sums), used as often as the
  counts allow; where no exact filling exists the best-fitting length goes in and the search goes on.
* ``best_fit_decreasing_plan``: lengths go, longest first, into the open sequences with the least
  sufficient room, found with a segment tree over room sizes.

Defined cases: a null text counts as empty and is one piece holding only the end id; an empty table
gives an empty result; repeated rows are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import frugal, materialise

CAPACITY = 4096
END_ID = 1
RANK_GROUP_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "sequence_id long, offset long"

Run = tuple[int, int, int, int, int, int]  # length, first rank, ranks, first sequence, offset, copies a sequence


def id_type(model: bpe.WordBpe) -> str:
    """The numpy type that holds every id of the vocabulary."""
    return "<u2" if len(model.tokens) <= 1 << 16 else "<u4"


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Encode each text, append ``end_id`` and cut what exceeds ``capacity``: one row for each piece.

    ``with_ids`` adds the ids as Zstandard-compressed little-endian numbers of the vocabulary's ``id_type``.
    """
    path = tokenizer_path or bpe.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        kind = id_type(encoder.bpe)
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                doc_ids = part.column(0).to_pylist()
                out: list[list] = [[] for _ in range(6)]
                for doc_id, ids in zip(doc_ids, encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        raw = ids[start : start + capacity].tobytes()
                        row = (doc_id, k, start, len(raw) // 4, zlib.crc32(raw), codec.compress(ids[start : start + capacity].astype(kind).tobytes(), asbytes=True) if with_ids else None)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:keep], types, strict=False)], names[:keep])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(encode), PIECES + (", ids binary" if with_ids else ""))


def length_histogram(pieces: DataFrame, capacity: int) -> np.ndarray:
    """How many pieces there are of each length up to ``capacity``: the only thing the driver sees."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return counts


class SumIndex:
    """For every sum up to the capacity a single length, a pair and a triple of lengths that make it, under availability counts.

    Built over all available lengths at once: ``pairs[s]`` holds the larger length of a pair with sum s, ``triples[s]`` one length of a triple.
    ``have`` is shared with the caller, who uses lengths up; an entry whose lengths have run out is looked for anew when it is met.
    """

    def __init__(self, have: np.ndarray):
        self.have, size = have, len(have)
        self.pairs, self.triples = np.zeros(size, np.int64), np.zeros(size, np.int64)
        lengths = np.flatnonzero(have > 0)
        for a in lengths.tolist():  # ascending, so that the largest stays
            sums = a + lengths[: np.searchsorted(lengths, min(a, size - 1 - a), "right")]
            self.pairs[sums] = a
        made = np.flatnonzero(self.pairs)
        for a in lengths.tolist():
            sums = a + made[: np.searchsorted(made, size - 1 - a, "right")]
            self.triples[sums] = a

    def pair(self, total: int) -> tuple[int, ...]:
        """Two available lengths with this sum, the larger first; () if there are none."""
        if total < 2:
            return ()
        have, a = self.have, int(self.pairs[total])
        if not (a and have[a] > 0 and have[total - a] > (2 * a == total)):
            first = np.arange((total + 1) // 2, total)
            at = np.flatnonzero((have[first] > 0) & (have[total - first] > (first * 2 == total)))
            if not len(at):
                return ()
            a = self.pairs[total] = int(first[at[-1]])
        return a, total - a

    def _with(self, a: int, total: int) -> tuple[int, ...]:
        self.have[a] -= 1
        rest = self.pair(total - a) if self.have[a] >= 0 else ()
        self.have[a] += 1
        return (a, *rest) if rest else ()

    def find(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that sum to the gap; () if there are none."""
        if self.have[gap] > 0:
            return (gap,)
        if found := self.pair(gap):
            return found
        if (a := int(self.triples[gap])) and (found := self._with(a, gap)):
            return found
        # The largest of a triple has at least a third of the sum.
        for a in np.flatnonzero(self.have[: gap - 1] > 0)[::-1].tolist():
            if 3 * a < gap:
                break
            if found := self._with(a, gap):
                self.triples[gap] = a
                return found
        return ()


def exact_complement_plan(counts: np.ndarray, capacity: int) -> list[Run]:
    have, rank, runs, sequence = counts.copy(), np.zeros_like(counts), [], 0
    index = SumIndex(have)
    for longest in range(capacity, 0, -1):
        while have[longest] > 0:
            pattern, gap = [longest], capacity - longest
            have[longest] -= 1
            while gap > 0:
                if not (added := index.find(gap)):
                    below = np.flatnonzero(have[1 : gap + 1] > 0)
                    if not len(below):
                        break
                    added = (int(below[-1]) + 1,)
                for a in added:
                    have[a] -= 1
                    gap -= a
                pattern += added
            used = Counter(pattern)
            for a, n in used.items():
                have[a] += n
            times = int(min(have[a] // n for a, n in used.items()))
            offset = 0
            for a, n in used.items():
                runs.append((a, int(rank[a]), times * n, sequence, offset, n))
                rank[a] += times * n
                have[a] -= times * n
                offset += a * n
            sequence += times
    return runs


class RoomTree:
    """Segment tree over room sizes 0..capacity; finds the least size of at least ``need`` in use."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.used = np.zeros(2 * self.leaves, bool)

    def set(self, size: int, used: bool) -> None:
        node = size + self.leaves
        self.used[node] = used
        while node > 1:
            node //= 2
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def least(self, need: int) -> int | None:
        node = need + self.leaves
        if self.used[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.used[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing_plan(counts: np.ndarray, capacity: int) -> list[Run]:
    runs: list[Run] = []
    tree, open_groups = RoomTree(capacity), {}
    sequence = 0

    def put(room: int, first: int, n: int) -> None:
        open_groups.setdefault(room, []).append((first, n))
        tree.set(room, True)

    for length in range(capacity, 0, -1):
        left, rank = int(counts[length]), 0
        while left:
            room = tree.least(length)
            if room is None:
                room, first, n = capacity, sequence, -(-left // (capacity // length))
                sequence += n
            else:
                first, n = open_groups[room].pop()
                if not open_groups[room]:
                    tree.set(room, False)
            copies = room // length
            whole = min(n, left // copies)
            if whole:
                runs.append((length, rank, whole * copies, first, capacity - room, copies))
                rank, left = rank + whole * copies, left - whole * copies
                put(room - copies * length, first, whole)
            if whole < n and left and left < copies:
                runs.append((length, rank, left, first + whole, capacity - room, left))
                put(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            if whole < n:
                put(room, first + whole, n - whole)
    return runs


def place(pieces: DataFrame, runs: list[Run]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to each row of a written table of pieces."""
    salts = max(64, -(-pieces.count() // RANK_GROUP_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("_rank", within - 1).join(starts, ["length", "_salt"])
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    columns = pieces.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 40 | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy(zero_copy_only=False) + batch.column("_before").to_numpy()
            run = table[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 3] + nth // run[:, 5], run[:, 4] + nth % run[:, 5] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*columns, "_rank", "_before").mapInArrow(look_up, f"{schema}, {PLACES}")


def pack_best_fit(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Operator 1: pack the documents' ids into as few sequences of ``capacity`` as exact complements find."""
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return place(pieces, exact_complement_plan(length_histogram(pieces, capacity), capacity))


SEQUENCES = "sequence_id long, n_tokens long, n_segments int, doc_ids array<long>, pieces array<int>, cu_lengths array<int>, ids binary, position_ids binary"


def pack_matrix(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """Operator 10: packed id rows for training, one row for each sequence.

    ``ids`` and ``position_ids`` are ``capacity`` little-endian unsigned 32-bit numbers, padded with
    ``pad_id`` and 0; positions restart at 0 with every segment. ``cu_lengths`` are the cumulative
    segment lengths from 0. ``doc_ids`` and ``pieces`` tell which piece each segment is; an overlong
    document's pieces joined in order give its ids back.
    """
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids=True), "pieces")
    placed = place(pieces, best_fit_decreasing_plan(length_histogram(pieces, capacity), capacity))
    segment = F.struct("offset", "length", "doc_id", "piece", "ids")
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))

    path = tokenizer_path or bpe.default_path()

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(id_type(bpe.load(path)))
        codec = pa.Codec("zstd")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for sequence, segments in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.full(capacity, pad_id, "<u4")
                    positions = np.zeros(capacity, "<u4")
                    cumulative = [0]
                    for s in segments:
                        end = s["offset"] + s["length"]
                        ids[s["offset"] : end] = np.frombuffer(codec.decompress(s["ids"], s["length"] * kind.itemsize), kind)
                        positions[s["offset"] : end] = np.arange(s["length"])
                        cumulative.append(end)
                    out.append((sequence, cumulative[-1], len(segments), [s["doc_id"] for s in segments], [s["piece"] for s in segments], cumulative, ids.tobytes(), positions.tobytes()))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                names = ["sequence_id", "n_tokens", "n_segments", "doc_ids", "pieces", "cu_lengths", "ids", "position_ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(lay_out, SEQUENCES)


SHARD_ROWS = 256
SHARDS = "shard long, first_sequence long, n_rows int, ids binary, segments binary, offsets binary, crc32 long"


def write_shards(matrix: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> None:
    """Write ``pack_matrix``'s rows as shards of a packed id matrix, and an index of them, as Parquet below ``path``.

    A shard holds ``shard_rows`` neighbouring sequences: ``ids`` is their matrix of little-endian unsigned 32-bit ids, row by row, ``segments`` all
    cumulative lengths (signed 32-bit) and ``offsets`` where each row's begin (64-bit, one more than rows). The index has a row a
    shard, without the data, so that a reader finds a sequence's shard and row from its number and checks it by its CRC.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, rows = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                ids = b"".join(r["ids"] for r in rows)
                ends = np.concatenate([[0], np.cumsum([len(r["cu_lengths"]) for r in rows])]).astype("<i8")
                segments = np.concatenate([r["cu_lengths"] for r in rows]).astype("<i4").tobytes()
                values = [shard, rows[0]["sequence_id"], len(rows), ids, segments, ends.tobytes(), zlib.crc32(ids)]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["shard", "first_sequence", "n_rows", "ids", "segments", "offsets", "crc32"])

    row = F.struct("sequence_id", "ids", "cu_lengths")
    shards = matrix.groupBy(F.floor(F.col("sequence_id") / shard_rows).alias("shard")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    shards.mapInArrow(frugal(join), SHARDS).write.mode("overwrite").parquet(f"{path}/shards")
    matrix.sparkSession.read.parquet(f"{path}/shards").select("shard", "first_sequence", "n_rows", "crc32").write.mode("overwrite").parquet(f"{path}/index")


def read_shards(spark, path: str, capacity: int = CAPACITY, sequences: list[int] | None = None) -> DataFrame:
    """``sequence_id, ids, cu_lengths, intact`` of written shards, or of the shards that hold some sequences: those alone are read."""
    shards = spark.read.parquet(f"{path}/shards")
    if sequences is not None:
        first = F.col("first_sequence")
        holds = [r["shard"] for r in spark.read.parquet(f"{path}/index").where(F.exists(F.array(*map(F.lit, sequences)), lambda s: (s >= first) & (s < first + F.col("n_rows")))).select("shard").collect()]
        shards = shards.where(F.col("shard").isin(holds))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends, lengths = np.frombuffer(r["offsets"], "<i8"), np.frombuffer(r["segments"], "<i4")
                at = [i for i in range(r["n_rows"]) if sequences is None or r["first_sequence"] + i in sequences]
                columns = [pa.array([r["first_sequence"] + i for i in at], pa.int64()), pa.array([r["ids"][4 * capacity * i : 4 * capacity * (i + 1)] for i in at], pa.binary()), pa.array([lengths[ends[i] : ends[i + 1]].tolist() for i in at], pa.list_(pa.int32())), pa.array([zlib.crc32(r["ids"]) == r["crc32"]] * len(at), pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["sequence_id", "ids", "cu_lengths", "intact"])

    return shards.mapInArrow(part, "sequence_id long, ids binary, cu_lengths array<int>, intact boolean")
