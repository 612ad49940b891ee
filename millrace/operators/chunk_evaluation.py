"""Chunking variants, and how well each keeps what belongs together.

Chunks, sentences and gold spans are intervals of white-space tokens of their document. Gold spans are ``must`` (to be held by
one chunk) and ``unsafe`` (to stand alone): they meet the chunks in an overlap join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions.storage import materialise
from . import chunking
from .intervals import overlap_join

SENTENCE_END = chunking.SENTENCE_END.pattern
#: A white-space token.
WORD = "(?U)\\S+"
# A chunk is contaminated if it holds more words beside an unsafe span than this.
OUTSIDE_WORDS = 3
# Neighbouring sentences with less in common than this are parted.
LEAST_COHESION = 0.08

CHUNK = "doc_id long, chunk int, l_start long, l_end long"


def placed(rows: DataFrame) -> DataFrame:
    """``start`` and ``end`` in place of ``n``: where each part of a document lies in tokens. Parts without a token go.

    ``rows`` come straight from ``posexplode``: a document's parts stand together, from ``position`` 0, and nothing is to be shuffled.
    """
    kept = [c for c in rows.columns if c != "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n, first = batch.column("n").to_numpy().astype(np.int64), batch.column("position").to_numpy() == 0
            end = np.cumsum(n) + before
            end -= np.maximum.accumulate(np.where(first, end - n, 0))
            before = int(end[-1]) if len(end) else before
            placed = pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(end - n), pa.array(end)], [*kept, "start", "end"])
            yield placed.filter(pa.array(n > 0))

    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in kept], *StructType.fromDDL("start long, end long").fields]))


def parts(rows: DataFrame, texts: Column, marks: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, position, start, end`` and the ``marks`` (the ``text``, without any) of each of the texts, placed in tokens."""
    each = rows.select("doc_id", F.posexplode(texts).alias("position", "text"))
    marks = {"text": F.col("text")} if marks is None else marks
    return placed(each.select("doc_id", "position", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n"), *[c.alias(n) for n, c in marks.items()]))


def sentence_spans(docs: DataFrame, marks: dict[str, Column] | None = None) -> DataFrame:
    """Sentences end at ``.``, ``!`` or ``?`` before a capital, a digit or a quote. ``marks`` are made of ``position`` and ``text``."""
    return parts(docs, F.split(F.coalesce("text", F.lit("")), SENTENCE_END), marks)


def slid(spans: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Each interval as windows of ``size`` tokens; the last ends with it."""
    step = max(1, size - overlap)
    last = F.greatest(F.ceil((F.col("end") - F.col("start") - size) / step), F.lit(0))
    each = spans.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("start") + F.col("k") * step
    own = [c for c in ("variant", "doc_id") if c in spans.columns]
    return each.select(*own, first.alias("l_start"), F.least(first + size, F.col("end")).alias("l_end"))


def fixed_window(sentences: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    whole = sentences.groupBy("doc_id").agg(F.lit(0).cast("long").alias("start"), F.max("end").alias("end"))
    return slid(whole, size, overlap)


def atomic_sentence(sentences: DataFrame, size: int) -> DataFrame:
    """A sentence a chunk; longer ones are cut into windows."""
    return slid(sentences, size)


def paragraph_or_sentence(docs: DataFrame, size: int) -> DataFrame:
    """A paragraph a chunk if it fits; sentences of the others."""
    paragraphs = F.split(F.coalesce("text", F.lit("")), "\\n\\s*\\n+")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.regexp_count(p, F.lit(WORD)) <= size, F.array(p)).otherwise(F.split(p, SENTENCE_END))))
    return slid(parts(docs, units, {}), size)


def grouped(docs: DataFrame, size: int) -> DataFrame:
    """``variant, doc_id, l_start, l_end`` of two variants: sentences packed up to ``size`` tokens (``boundary_aware``), and parted
    also where neighbours have too few words in common and around instructions (``semantic_cohesion``)."""
    instruction = re.compile(fixed.INSTRUCTION_LIKE)
    word = re.compile(r"\w{4,}")

    def pack(spans: list[chunking.Span], apart: list[bool]) -> Iterator[tuple[int, int]]:
        """Runs of spans up to ``size`` tokens; ``apart`` tells which must not follow the one before."""
        start = end = 0
        for (_, a, b), cut in zip(spans, apart, strict=True):
            if end > start and (cut or b - start > size):
                yield start, end
                start = a
            end = b
        if end > start:
            yield start, end

    def breaks(text: str, spans: list[chunking.Span]) -> list[bool]:
        terms = [set(word.findall(s[0].lower())) for s in spans]
        alone = [bool(instruction.search(s[0])) for s in spans] if instruction.search(text) else [False] * len(spans)
        out = [False] * len(spans)
        for i in range(1, len(spans)):
            both = len(terms[i - 1] & terms[i])
            all_ = len(terms[i - 1]) + len(terms[i]) - both
            out[i] = alone[i - 1] or alone[i] or (both / all_ if all_ else 0.0) < LEAST_COHESION
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = chunking.spans(t or "", chunking.SENTENCE_END)
                for name, apart in (("boundary_aware", [False] * len(spans)), ("semantic_cohesion", breaks(t or "", spans))):
                    for found in pack(spans, apart):
                        for column, value in zip(out, (name, d, *found), strict=True):
                            column.append(value)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["variant", "doc_id", "start", "end"])

    return slid(docs.select("doc_id", "text").mapInArrow(cut, "variant string, doc_id long, start long, end long"), size)


def variants(docs: DataFrame, size: int, sequential: bool = False, sentences: DataFrame | None = None) -> DataFrame:
    """``variant, doc_id, l_start, l_end`` of every variant; the sequential ones depend on all that stands before.

    ``sentences`` is ``sentence_spans(docs)`` where the caller has it.
    """
    sentences = sentence_spans(docs, {}) if sentences is None else sentences
    made = {"fixed_window": fixed_window(sentences, size), "atomic_sentence": atomic_sentence(sentences, size), "paragraph_or_sentence": paragraph_or_sentence(docs, size)}
    rows = [rows.select(F.lit(name).alias("variant"), "doc_id", "l_start", "l_end") for name, rows in made.items()]
    return reduce(DataFrame.unionByName, [*rows, *([grouped(docs, size)] if sequential else [])])


def gold_spans(sentences: DataFrame, must: Column, unsafe: Column) -> DataFrame:
    """``doc_id, r_start, r_end, unsafe`` of the sentences that must be kept whole or that are unsafe."""
    return sentences.withColumns({"_unsafe": unsafe, "_must": must}).where("_unsafe or _must").select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("_unsafe").alias("unsafe"))


def report(chunks: DataFrame, sentences: DataFrame, gold: DataFrame) -> DataFrame:
    """A row a variant: its chunks, how many start and end with sentences, and what became of the gold spans.

    ``kept_rate`` is the share of spans that one chunk holds whole, ``mean_pieces`` over how many chunks a span is spread; an unsafe span is
    ``isolated`` if a chunk holds it and no such chunk has more than three tokens beside it.
    """
    chunks, sentences = materialise(chunks, "chunks"), materialise(sentences.select("doc_id", "start", "end"), "sentences")
    starts = sentences.select("doc_id", F.col("start").alias("l_start"), F.lit(1).alias("at_start"))
    ends = sentences.select("doc_id", F.col("end").alias("l_end"), F.lit(1).alias("at_end"))
    aligned = chunks.join(starts, ["doc_id", "l_start"], "left").join(ends, ["doc_id", "l_end"], "left")
    tokens = F.col("l_end") - F.col("l_start")
    sizes = aligned.groupBy("variant").agg(F.count("*").alias("chunks"), F.round(F.avg(tokens), 6).alias("mean_tokens"), F.round(F.count_if(F.col("at_start").isNotNull() & F.col("at_end").isNotNull()) / F.count("*"), 6).alias("boundary_precision"))
    met = overlap_join(chunks, gold, ["doc_id"])
    holds = (F.col("l_start") <= F.col("r_start")) & (F.col("r_end") <= F.col("l_end"))
    beside = tokens - (F.col("r_end") - F.col("r_start"))
    each = met.groupBy("variant", "doc_id", "r_start", "r_end", "unsafe").agg(F.count("*").alias("pieces"), F.bool_or(holds).alias("kept"), F.count_if(holds & (beside > OUTSIDE_WORDS)).alias("dirty"))
    spans = each.groupBy("variant").agg(
        F.count("*").alias("spans"), F.round(F.avg(F.col("kept").cast("int")), 6).alias("kept_rate"), F.round(F.avg("pieces"), 6).alias("mean_pieces"), F.count_if("unsafe").alias("unsafe_spans"), F.count_if(F.col("unsafe") & F.col("kept") & (F.col("dirty") == 0)).alias("isolated")
    )
    return sizes.join(spans, "variant", "left")
