"""Byte-pair encoding and decoding with a lexicon of frequent words (operator 7).

Spark counts the pieces of all texts. The words of the most frequent pieces, ``max_words`` at most, are compiled
into a minimal acyclic automaton (states with equal continuations are shared); each edge carries
how many words precede those behind it, so that a path gives a word's number and the number its ids.
The arrays are one bounded byte string; each Python worker writes it to an unlinked temporary file and
maps it into memory. Words are looked up thousands at a time; words outside it are merged exactly.

Defined cases: a null text counts as empty (no ids, empty decoded text); an empty table gives an empty
result; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialise

MAX_WORDS = 65_536


def build(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The automaton of ``words`` and their ids, as bytes that ``Lexicon`` maps."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...))

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the open states of the last word, from the root
    last = b""
    for word in sorted(words):
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for depth in range(len(last), common, -1):
            child = freeze(path.pop())
            path[depth - 1][1].append((last[depth - 1], child))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        child = freeze(path.pop())
        path[depth - 1][1].append((last[depth - 1], child))
    root = freeze(path.pop())
    behind = np.zeros(len(states), np.int64)
    for s, (final, edges) in enumerate(states):  # children are frozen before their parents
        behind[s] = final + sum(behind[t] for _, t in edges)
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(states):
        skip = int(final)
        for byte, t in edges:
            keys.append(s << 8 | byte)
            targets.append(t)
            skips.append(skip)
            skip += int(behind[t])
    ids = [words[w] for w in sorted(words)]
    ends = np.cumsum([0, *map(len, ids)])
    arrays = (np.array([root]), np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), np.array([f for f, _ in states], np.int64), ends.astype(np.int64), np.array([i for t in ids for i in t], np.int64))
    out = io.BytesIO()
    out.write(np.array([len(a) for a in arrays], np.int64).tobytes())
    for a in arrays:
        out.write(a.astype(np.int64).tobytes())
    return out.getvalue()


class Lexicon:
    """The automaton, mapped from a file; called with words it gives their ids, None for unknown ones."""

    PARTS = 7

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            mapped = np.memmap(f, np.int64, "r")
        at = self.PARTS
        parts = []
        for n in mapped[: self.PARTS].tolist():
            parts.append(mapped[at : at + n])
            at += n
        root, self.keys, self.targets, self.skips, self.final, self.ends, self.ids = parts
        self.root = int(root[0])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if it is unknown."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        found = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return found
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths > 0)
        state, number = np.full(len(live), self.root), np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            key = state << 8 | flat[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            at, live, number = at[ok], live[ok], number[ok]
            state, number = self.targets[at], number + self.skips[at]
            depth += 1
            over = lengths[live] == depth
            done = over & (self.final[state] > 0)
            found[live[done]] = number[done]
            live, state, number = live[~over], state[~over], number[~over]
        return found

    def __call__(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        return [None if n < 0 else tuple(self.ids[self.ends[n] : self.ends[n + 1]].tolist()) for n in self.numbers(words).tolist()]


def frequent_words(docs: DataFrame, encoder: bpe.WordBpe, max_words: int = MAX_WORDS) -> dict[bytes, tuple[int, ...]]:
    """The words of the most frequent white-space pieces of all texts, with their ids.

    All pieces above the least count (in steps) that leaves ``max_words`` at most: no more than those reach the driver.
    """
    pieces = docs.select(F.explode(F.split("text", "[ \\t\\n\\r\\x0b\\f]+")).alias("piece")).where("piece <> ''")
    # Steps of count, sixteen to a doubling: so few that their histogram fits any driver.
    counts = materialise(pieces.groupBy("piece").count().select("piece", F.floor(F.log2("count") * 16).cast("int").alias("step")), "pieces")
    least, room = None, max_words
    for row in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    top = [] if least is None else counts.where(F.col("step") >= least).select("piece").collect()
    words = list({w for row in top for w in encoder.split_piece(row["piece"].encode("utf-8", "replace")) or ()})
    return dict(zip(words, encoder.merge_words(words), strict=True))


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None, max_words: int = MAX_WORDS, with_ids: bool = False) -> DataFrame:
    """Operator 7: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; ``with_ids`` adds ``ids`` and ``decoded``."""
    path = tokenizer_path or bpe.default_path()
    data = build(frequent_words(docs, bpe.load(path), max_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        encoder = bpe.PieceEncoder(model, Lexicon(data))
        digits = [b"%d" % i for i in range(len(model.tokens))]
        names = [t.encode() for t in model.tokens]
        id_texts: list[bytes] = []
        token_texts: list[bytes] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = encoder.index(part.column(1).to_pylist())
                if len(encoder.lengths) < len(id_texts):  # the cache was emptied
                    id_texts.clear()
                    token_texts.clear()
                for k in range(len(id_texts), len(encoder.lengths)):
                    ids = encoder.flat[encoder.starts[k] : encoder.starts[k] + encoder.lengths[k]].tolist()
                    id_texts.append(b" ".join([digits[i] for i in ids]))
                    token_texts.append(b" ".join([names[i] for i in ids]))
                out: list[list] = [[], [], [], [], []]
                for at in found:
                    n = encoder.lengths[at]
                    if len(n) and n.min() == 0:
                        at = at[n > 0]
                    pieces = at.tolist()
                    ids, decoded = b" ".join([id_texts[k] for k in pieces]), b" ".join([token_texts[k] for k in pieces])
                    out[0].append(int(n.sum()))
                    out[1].append(hashlib.sha256(ids).hexdigest())
                    out[2].append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        out[3].append([int(i) for i in ids.split()])
                        out[4].append(decoded.decode())
                columns = [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                if with_ids:
                    columns += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
