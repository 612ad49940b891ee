"""Registered queries of chunking variants and their evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .functions.storage import materialise
from .operators import chunk_evaluation, evidence
from .oracles import ROUGH, contains_any, pattern

SIZE = 60
#: A sentence with one of these is evidence that a chunk should hold whole.
EVIDENCE = ["evidence", "found", "show", "result", "percent", "sample", "because"]
UNSAFE = ["instruction_override", "exfiltration"]
UNSAFE_PATTERNS = [p for name in UNSAFE for p in fixed.SAFETY_PATTERNS[name]]


def _evaluated(spark: SparkSession, sf_dir: str, sequential: bool) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    low = F.lower("text")
    must = F.greatest(*[low.contains(w) for w in EVIDENCE]) | (F.pmod(F.col("position"), F.lit(10)) == 9)
    marks = {"must": must, "unsafe": evidence.matches(low, UNSAFE)}
    sentences = materialise(chunk_evaluation.sentence_spans(docs, marks), "sentences")
    gold = chunk_evaluation.gold_spans(sentences, F.col("must"), F.col("unsafe"))
    return chunk_evaluation.report(chunk_evaluation.variants(docs, SIZE, sequential, sentences), sentences, gold)


def chunk_evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence sentences and every tenth one as gold spans, unsafe ones apart, under the three variants that SQL can express."""
    return _evaluated(spark, sf_dir, False)


def chunk_evaluation_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under all five variants."""
    return _evaluated(spark, sf_dir, True)


def chunk_variant_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document under each variant, and their tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = F.col("l_end") - F.col("l_start")
    return chunk_evaluation.variants(docs, SIZE).groupBy("variant", "doc_id").agg(F.count("*").alias("chunks"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"))


QUERIES = {f.__name__: f for f in (chunk_evaluation_report, chunk_evaluation_sequential, chunk_variant_sizes)}


def split_sql(text: str) -> str:
    return f"string_split(regexp_replace({text}, '([.!?])\\s+([A-Z0-9\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


SPANS = f"""
s0 AS (SELECT doc_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS position FROM (SELECT doc_id, {split_sql("coalesce(text, '')")} AS ss FROM documents)),
s1 AS (SELECT *, len({ROUGH.format('text')}) AS n FROM s0),
sent AS (SELECT doc_id, position, text, sum(n) OVER w - n AS a, sum(n) OVER w AS b FROM s1 WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
p0 AS (SELECT doc_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS position FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\n\\s*\\n+') AS ss FROM documents)),
p1 AS (SELECT *, len({ROUGH.format('text')}) AS n FROM p0),
para AS (SELECT doc_id, position, text, sum(n) OVER w - n AS a, sum(n) OVER w AS b FROM p1 WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
q0 AS (SELECT doc_id, a AS pa, unnest(ss) AS text, generate_subscripts(ss, 1) AS k FROM (SELECT doc_id, a, {split_sql('text')} AS ss FROM para WHERE b - a > {SIZE})),
q1 AS (SELECT *, len({ROUGH.format('text')}) AS n FROM q0),
inner_ AS (SELECT doc_id, pa + sum(n) OVER w - n AS a, pa + sum(n) OVER w AS b FROM q1 WHERE n > 0 WINDOW w AS (PARTITION BY doc_id, pa ORDER BY k)),
whole AS (SELECT doc_id, 0 AS a, len({ROUGH.format('text')}) AS b FROM documents),
runs AS (SELECT 'fixed_window' AS variant, doc_id, a, b FROM whole WHERE b > 0 UNION ALL SELECT 'atomic_sentence', doc_id, a, b FROM sent UNION ALL SELECT 'paragraph_or_sentence', doc_id, a, b FROM inner_ UNION ALL SELECT 'paragraph_or_sentence', doc_id, a, b FROM para WHERE b - a <= {SIZE}),
chunk AS (SELECT variant, doc_id, (a + k * {SIZE})::BIGINT AS s, least(a + k * {SIZE} + {SIZE}, b)::BIGINT AS e FROM (SELECT *, unnest(range(0, greatest(ceil((b - a - {SIZE}) / {SIZE}.0), 0)::BIGINT + 1)) AS k FROM runs))"""

ORACLE_SQL = {
    "chunk_variant_sizes": f"WITH {SPANS} SELECT variant, doc_id, count(*) AS chunks, sum(e - s)::BIGINT AS tokens, max(e - s) AS longest FROM chunk GROUP BY ALL",
    "chunk_evaluation_report": f"""WITH {SPANS},
g0 AS (SELECT doc_id, a, b, {contains_any('text', EVIDENCE)} OR position % 10 = 9 AS must, regexp_matches(lower(text), '(?s){'|'.join('(?:' + pattern(p) + ')' for p in UNSAFE_PATTERNS)}') AS unsafe FROM sent),
gold AS (SELECT doc_id, a, b, unsafe FROM g0 WHERE must OR unsafe),
al AS (SELECT variant, count(*) AS chunks, round(avg(e - s), 6) AS mean_tokens, round(count(*) FILTER (x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL) / count(*), 6) AS boundary_precision FROM chunk c LEFT JOIN sent x ON x.doc_id = c.doc_id AND x.a = s LEFT JOIN sent y ON y.doc_id = c.doc_id AND y.b = e GROUP BY variant),
met AS (SELECT variant, g.doc_id, a, b, unsafe, count(*) AS pieces, bool_or(s <= a AND b <= e) AS kept, count(*) FILTER (s <= a AND b <= e AND e - s - (b - a) > {chunk_evaluation.OUTSIDE_WORDS}) AS dirty FROM chunk c JOIN gold g ON c.doc_id = g.doc_id AND s < b AND a < e GROUP BY ALL),
sp AS (SELECT variant, count(*) AS spans, round(avg(kept::INT), 6) AS kept_rate, round(avg(pieces), 6) AS mean_pieces, count(*) FILTER (unsafe) AS unsafe_spans, count(*) FILTER (unsafe AND kept AND dirty = 0) AS isolated FROM met GROUP BY variant)
SELECT * FROM al LEFT JOIN sp USING (variant)""",
}
