"""Readers that turn files into source records, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

TEXT_FIELDS = ["text", "content", "body", "message", "comment", "abstract", "description", "summary"]
TITLE_FIELDS = ["title", "subject", "headline", "name"]
ID_FIELDS = ["id", "doc_id", "document_id", "_id", "uuid", "key"]
WRAPPERS = ["records", "documents", "items", "data", "posts", "comments"]
IGNORED_FOLDERS = [".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", "build", "dist"]


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; bad lines fail the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, or an object that holds one under a usual name, or a single record."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    for name in WRAPPERS:
        if name in raw.columns and raw.schema[name].dataType.typeName() == "array":
            return raw.select(F.explode(name).alias("r")).select("r.*")
    return raw


def csv_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Header and strings, with ``source_file`` and ``source_row`` (from 1 within the file)."""
    rows = spark.read.option("header", True).option("sep", separator).csv(path)
    rows = rows.withColumns({"source_file": F.col("_metadata.file_name"), "_at": F.monotonically_increasing_id()})
    return rows.withColumn("source_row", F.row_number().over(Window.partitionBy("source_file").orderBy("_at"))).drop("_at")


def first_column(df: DataFrame, names: list[str], cast: str = "string") -> Column:
    there = [F.col(n).cast(cast) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast(cast)


def tsv_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, doc_id, relevance``; the last row of a pair wins."""
    rows = csv_records(spark, path, "\t")
    named = rows.select("source_row", first_column(rows, ["query-id", "query_id", "qid"]).alias("query_id"), first_column(rows, ["corpus-id", "corpus_id", "docid"]).alias("doc_id"), first_column(rows, ["score", "relevance"], "double").alias("relevance"))
    return named.groupBy("query_id", "doc_id").agg(F.max_by("relevance", "source_row").alias("relevance"))


def trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """White-space columns ``query, iteration, doc, grade``; comments skipped, short lines fail."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    parts = F.split(F.trim("value"), "\\s+")
    rows = lines.select(parts.alias("p"), F.when(F.size(parts) < 4, F.raise_error(F.concat(F.lit("short qrels line: "), "value"))).alias("_bad"))
    return rows.where("_bad is null").select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("double").alias("relevance"))


def benchmark_corpus(records: DataFrame, required: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """First row of each ``_id``, blank texts dropped, title in front unless the text starts with it.

    ``most`` keeps that many documents by file order and, besides, all of ``required``'s ``doc_id``.
    """
    rows = records.withColumn("_at", F.monotonically_increasing_id()).where("trim(coalesce(text, '')) <> ''")
    first = rows.groupBy(F.col("_id").alias("doc_id")).agg(F.min_by(F.struct("title", "text"), "_at").alias("r"), F.min("_at").alias("_at"))
    title, text = F.trim(F.coalesce("r.title", F.lit(""))), F.col("r.text")
    joined = F.when((title == "") | F.startswith(text, title), text).otherwise(F.concat_ws("\n\n", title, text))
    docs = first.select("doc_id", "_at", title.alias("title"), joined.alias("text"))
    if most is not None:
        early = docs.orderBy("_at").limit(most).select("doc_id")
        keep = early if required is None else early.union(required.select("doc_id")).distinct()
        docs = docs.join(keep, "doc_id", "left_semi")
    return docs.drop("_at")


def whole_files(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """Every file below ``path`` with one of the extensions, outside ignored folders, as one record of text."""
    ignored = "/(" + "|".join(f.replace(".", "\\.") for f in IGNORED_FOLDERS) + ")/"
    wanted = "\\.(" + "|".join(extensions) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.where(~F.col("path").rlike(ignored) & F.lower("path").rlike(wanted))
    kind = F.when(F.lower("path").rlike("\\.(md|markdown)$"), "note").otherwise("unknown_unstructured_text")
    return files.select(F.concat(F.lit("file:"), F.substring(F.sha1(F.col("path")), 1, 16)).alias("id"), "path", kind.alias("document_type"), F.decode("content", F.lit("UTF-8")).alias("text"))


def notebook_cells(files: DataFrame) -> DataFrame:
    """``id, section, text`` of every cell with text; a cell's number counts all cells."""
    schema = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"
    cells = files.select("id", F.posexplode(F.from_json("text", schema)["cells"]).alias("i", "cell"))
    joined = F.array_join("cell.source", "")
    return cells.where(F.trim(joined) != "").select("id", F.concat_ws("_", "cell.cell_type", (F.col("i") + 1).cast("string")).alias("section"), joined.alias("text"))


def html_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``title`` and ``text``: scripts and styles dropped, tags removed, blank lines dropped."""
    raw = F.coalesce(F.col(html), F.lit(""))
    title = F.trim(F.regexp_extract(raw, "(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.regexp_replace(raw, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "\n")
    body = F.regexp_replace(body, "(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.withColumns({"title": title, "text": F.array_join(lines, "\n")})


def bibliographic_works(records: DataFrame) -> DataFrame:
    """Works from bibliographic records: abstract from its inverted index, nested fields with fallbacks."""
    names = F.transform("authorships", lambda a: a["author"]["display_name"])
    cited = F.transform("authorships", lambda a: a["author"]["cited_by_count"])
    return records.select(
        "id",
        "doi",
        "title",
        F.col("publication_year").alias("year"),
        "language",
        T.abstract_from_positions(F.col("abstract_inverted_index")).alias("abstract"),
        F.col("primary_location.source.display_name").alias("source_name"),
        T.first_present(F.col("primary_location.pdf_url"), F.col("best_oa_location.pdf_url"), F.col("open_access.oa_url")).alias("pdf_url"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_open_access"),
        F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.size(F.coalesce("referenced_works", F.array().cast("array<string>"))).alias("referenced_work_count"),
        names.alias("author_display_names"),
        F.size(names).alias("author_count"),
        F.coalesce(F.array_max(cited), F.lit(0)).alias("max_author_cited_by_count"),
    )


def map_fields(records: DataFrame) -> DataFrame:
    """``id, title, text`` from the first field of each usual name that is not blank; null texts are left out."""
    there = set(records.columns)

    def pick(names: list[str]) -> Column:
        found = [F.col(n) for n in names if n in there]
        return T.first_present(*found) if found else F.lit(None).cast("string")

    rows = records.select(pick(ID_FIELDS).alias("given_id"), pick(TITLE_FIELDS).alias("title"), pick(TEXT_FIELDS).alias("text"))
    made = T.stable_id("record", F.coalesce("title", F.lit("")), F.col("text"))
    return rows.where(F.col("text").isNotNull()).select(F.coalesce("given_id", made).alias("id"), "title", "text")


def source_profile(records: DataFrame, rows: int = 25) -> DataFrame:
    """Non-blank values of each field over the first ``rows`` records: a preview, so bounded."""
    head = records.limit(rows)
    counts = [F.struct(F.lit(c).alias("field"), F.count_if(F.trim(F.col(c).cast("string")) != "").alias("present")) for c in records.columns]
    return head.agg(F.array(*counts).alias("f")).select(F.inline("f"))


def public_posts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable public posts with pseudonymous authors, and the skipped ones with their reason."""
    text = first_column(records, ["text", "comment", "body", "content"])
    reason = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "missing_text").when(F.col("visibility").isNull(), "missing_public").when(F.lower("visibility") != "public", "non_public")
    rows = records.withColumns({"_text": text, "reason": reason})
    good = rows.where("reason is null").select("id", "platform", "thread_id", F.try_to_timestamp("created_at").alias("created_at"), T.pseudonym(F.col("author_id")).alias("author"), F.col("_text").alias("text"))
    return good, rows.where("reason is not null").select("id", "reason")
