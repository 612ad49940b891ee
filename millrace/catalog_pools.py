"""Registered queries of filtered and windowed search, query expansion, claim clusters and the keyed index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.storage import materialise, scratch_uri
from .operators import clustering, evidence, expansion, retrieval
from .oracles import BM25, words
from .sources import keyed_index

BUCKETS = 64
QUERY_STEP = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of the query's own label; of any label for every other query."""
    vectors = _table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id") % QUERY_STEP == 0).withColumn("label", F.when(F.col("vec_id") % (2 * QUERY_STEP) != 0, F.col("label")))
    return retrieval.nearest(queries, vectors, where=["label"])


def windowed_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.windowed_pool(_asked(spark, sf_dir), _table(spark, sf_dir, "documents"))


def related_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.related_terms(_asked(spark, sf_dir), _table(spark, sf_dir, "documents"))


def _expansion(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    queries, docs = _asked(spark, sf_dir), _table(spark, sf_dir, "documents")
    return queries, docs, materialise(expansion.related_terms(queries, docs), "related")


def expanded_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs, related = _expansion(spark, sf_dir)
    return expansion.weighted_bm25(materialise(expansion.expanded_queries(queries, related), "wanted"), docs)


def query_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs, related = _expansion(spark, sf_dir)
    return expansion.diagnosed(queries, materialise(retrieval.bm25_top_k(queries, docs, 5), "top"), docs, related)


def claim_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of each query's ten best documents in clusters around the first of their kind, by rank and place."""
    queries, docs = _asked(spark, sf_dir), _table(spark, sf_dir, "documents")
    top = materialise(retrieval.bm25_top_k(queries, docs), "top")
    claims = evidence.claims(docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi"))
    rows = top.join(claims, "doc_id").select(F.col("query_id").alias("block"), F.struct("rank", "position").alias("id"), F.filter(F.array_distinct("_tokens"), lambda w: F.char_length(w) >= 3).alias("terms"))
    led = clustering.leaders(rows)
    return led.groupBy(F.col("block").alias("query_id"), F.col("leader.rank").alias("leader_rank"), F.col("leader.position").alias("leader_position")).agg(F.count("*").alias("claims"), F.count_distinct("id.rank").alias("documents"))


def index_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh of the document index does to each bucket when the toxic documents change and every fiftieth goes."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "n_chars", "toxic")
    first = rows.where(F.coalesce("toxic", F.lit(0)) == 0).unionByName(rows.where("toxic = 1").withColumn("digest", F.lit("before"))).drop("toxic")
    path = scratch_uri(spark, "index")
    keyed_index.refresh(path, 1, first, "doc_id", "digest", buckets=BUCKETS)
    return keyed_index.refresh(path, 2, rows.where("toxic = 1 or doc_id % 50 = 7").withColumn("deleted", F.col("doc_id") % 50 == 7).drop("toxic"), "doc_id", "digest", buckets=BUCKETS)


QUERIES = {f.__name__: f for f in (filtered_knn, windowed_pool, related_terms, expanded_bm25, query_diagnostics, claim_clusters, index_buckets)}

RELATED = f"""{BM25},
rt AS (SELECT doc_id, unnest(list_filter(list_distinct(ws), lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+'))) AS term FROM toks),
rf AS (SELECT term, count(*) AS df FROM rt GROUP BY term HAVING count(*) >= 3),
qt AS (SELECT DISTINCT term FROM asked),
own AS (SELECT doc_id, term, df FROM rt JOIN qt USING (term) JOIN rf USING (term)),
oth AS (SELECT doc_id, term AS other, df AS odf FROM rt JOIN rf USING (term), lens WHERE df <= 0.2::DOUBLE * n_docs),
rp AS (SELECT term, df, other, odf, count(*) AS together FROM own JOIN oth USING (doc_id) WHERE term <> other GROUP BY ALL HAVING count(*) >= 3),
related AS (SELECT term, other, together, round(2 * together / (df + odf), 6) AS weight, row_number() OVER (PARTITION BY term ORDER BY round(2 * together / (df + odf), 6) DESC, other) AS place FROM rp QUALIFY place <= 3)"""

ORACLE_SQL = {
    "filtered_knn": f"""WITH p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % {QUERY_STEP} = 0 AND (q.vec_id % {2 * QUERY_STEP} = 0 OR q.label = d.label)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM p) SELECT * FROM r WHERE rank <= 10""",
    "related_terms": f"WITH {RELATED} SELECT * FROM related",
    "expanded_bm25": f"""WITH {RELATED},
near AS (SELECT query_id, other AS term, max(weight) AS w FROM asked JOIN related USING (term) GROUP BY ALL),
fresh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, term) AS p FROM near ANTI JOIN asked USING (query_id, term)),
wanted AS (SELECT query_id, term, qtf::DOUBLE AS weight FROM asked UNION ALL SELECT query_id, term, round(w * 0.5::DOUBLE, 6) FROM fresh WHERE p <= 5),
s AS (SELECT query_id, doc_id, round(sum(weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM post JOIN df USING (term) JOIN wanted USING (term), lens GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 10""",
    "query_diagnostics": f"""WITH {RELATED},
q AS (SELECT item_id AS query_id, list_sort(list_distinct(list_filter({words('text')}, lambda w: length(w) >= 3))) AS terms FROM benchmark),
h AS (SELECT query_id, list_distinct(flatten(list(ws))) AS has FROM bm JOIN toks USING (doc_id) WHERE rank <= 5 GROUP BY query_id),
m AS (SELECT query_id, terms, list_filter(terms, lambda x: list_contains(coalesce(has, []), x) OR (x LIKE '%s' AND length(x) > 3 AND list_contains(coalesce(has, []), x[:-2])) OR list_contains(coalesce(has, []), x || 's')) AS matched FROM q LEFT JOIN h USING (query_id)),
o AS (SELECT query_id, list_sort(list(DISTINCT other)) AS offered FROM asked JOIN related USING (term) GROUP BY query_id)
SELECT query_id, array_to_string(matched, ',') AS matched, array_to_string(list_filter(terms, lambda x: NOT list_contains(matched, x)), ',') AS weak, array_to_string(list_filter(coalesce(offered, []), lambda x: NOT list_contains(terms, x)), ',') AS suggested FROM m LEFT JOIN o USING (query_id)""",
    "index_buckets": f"""WITH r AS (SELECT doc_id, coalesce(toxic, 0) = 1 AS toxic, (('0x' || left(md5(doc_id::VARCHAR), 6))::INT) % {BUCKETS} AS bucket FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT bucket, count(*) FILTER (doc_id % 50 <> 7) AS rows, 0::BIGINT AS added, count(*) FILTER (toxic AND doc_id % 50 <> 7) AS changed, count(*) FILTER (doc_id % 50 = 7) AS removed FROM r GROUP BY bucket)
SELECT b::INT AS bucket, coalesce(rows, 0)::BIGINT AS rows, coalesce(added, 0)::BIGINT AS added, coalesce(changed, 0)::BIGINT AS changed, coalesce(removed, 0)::BIGINT AS removed, coalesce(changed + removed, 0) > 0 AS rewritten FROM (SELECT unnest(range({BUCKETS})) AS b) LEFT JOIN f ON bucket = b""",
}
