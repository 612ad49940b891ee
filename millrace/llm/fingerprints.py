"""Canonical exact fingerprints of documents (operator 2), with DataFrame functions only.

A text's canonical form is its NFKC normal form with case folded (ICU, through the SQL function
``reflect``), runs of white space made one space and the ends trimmed. The fingerprint is 256 bits:
four xxhash64 values of the canonical form under different salts, in hexadecimal. Equal texts have
equal fingerprints; so have texts that differ only in normal form, case or spacing. As the digest is
exact, the likeness of two fingerprints is 1 if they are equal and 0 otherwise.

``classes`` groups equal fingerprints and compares canonical bytes inside each group, so that
even a collision of all 256 bits could not join different texts.

Defined cases: a null text counts as empty; a null doc_id sorts below all others; rows that repeat a
doc_id are ordered by their text's hash, and identical rows share one place, so each gets the same result;
a table of one document is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialise

LANES = 4
LOWEST = -(2**63)


def canonical(text: Column) -> Column:
    """NFKC, case folded, white space folded. ``text`` must not be null."""

    def nfkc(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), "[\\s\\p{Z}\\x{85}]+", " "))


def digest(canonical_text: Column) -> Column:
    lanes = [F.lpad(F.hex(F.xxhash64(F.lit(k), canonical_text)), 16, "0") for k in range(LANES)]
    return F.lower(F.concat(*lanes))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(text.alias("text"), F.coalesce(doc_id, F.lit(LOWEST)).alias("k"), F.xxhash64(text).alias("h"))


def order_chain(keyed: DataFrame) -> DataFrame:
    """For each document key its predecessor in descending order: ``k, h, copies, pk, ph, pn``.

    The first document's predecessor is the last one. Only keys are sorted, by range; the ends of the
    ranges (one row a partition) close the chain.
    """
    keys = keyed.groupBy("k", "h").agg(F.first(F.char_length("text").cast("long")).alias("n"), F.count("*").alias("copies"))
    ranged = materialise(keys.repartitionByRange(F.desc("k"), F.asc("h")).withColumn("range", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("range").orderBy(F.desc("k"), F.asc("h"))
    me = F.struct("k", "h", "n")
    before = ranged.withColumn("before", F.lag(me).over(inside))
    last = ranged.groupBy("range").agg(F.min_by(me, F.struct("k", -F.col("h"))).alias("last"))
    ends = last.withColumns({"previous": F.lag("last").over(Window.orderBy("range")), "final": F.last("last").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    closing = ends.select("range", F.coalesce("previous", "final").alias("closing"))
    chain = before.join(F.broadcast(closing), "range").withColumn("p", F.coalesce("before", "closing"))
    return chain.select("k", "h", "copies", F.col("p.k").alias("pk"), F.col("p.h").alias("ph"), F.col("p.n").alias("pn"))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Operator 2: each text's fingerprint, that of its edited text, and the likenesses.

    The edited text has its last half replaced by as much of the beginning of the next document.
    """
    keyed = _keyed(docs)
    chain = order_chain(keyed)
    # Both uses take the same three columns, so that the texts are shuffled once.
    whole = keyed.repartition("k", "h")
    linked = whole.join(chain, ["k", "h"])
    prefix = F.substring(F.col("text"), F.lit(1), (F.col("pn") / 2).cast("int"))
    following = linked.select("k", "h", "copies", F.col("pk"), F.col("ph"), prefix.alias("prefix"), canonical(F.col("text")).alias("form"))
    following = following.select("k", "h", "copies", "pk", "ph", "prefix", digest(F.col("form")).alias("next_fingerprint"))
    once = following.where("copies = 1").unionByName(following.where("copies > 1").dropDuplicates(["k", "h"]))
    rows = whole.join(once.select(F.col("pk").alias("k"), F.col("ph").alias("h"), "prefix", "next_fingerprint"), ["k", "h"])
    n = F.char_length("text").cast("long")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(kept, "prefix"))
    rows = rows.select(F.nullif("k", F.lit(LOWEST)).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_fingerprint", canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"))
    rows = rows.withColumns({"fingerprint": digest(F.col("form")), "edited_fingerprint": digest(F.col("edited_form")), "bytes_sha256": F.sha2("form", 256)})

    def likeness(other: str) -> Column:
        return (F.col("fingerprint") == F.col(other)).cast("double")

    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("edited_fingerprint").alias("near_edited"), likeness("next_fingerprint").alias("near_next"), "bytes_sha256")


def classes(docs: DataFrame) -> DataFrame:
    """``fingerprint, bytes_sha256, class_id, members``: the groups of two or more documents with equal canonical bytes.

    ``class_id`` is the least doc_id. Canonical texts are the grouping key, so equal bytes are what
    counts; copies collapse before the shuffle.
    """
    forms = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.coalesce("text", F.lit(""))).alias("form"))
    forms = forms.withColumn("fingerprint", digest(F.col("form")))
    shared = materialise(forms.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "shared")
    inside = join_small(forms, shared, ["fingerprint"], "left_semi")
    groups = inside.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    return groups.where("members > 1").select("fingerprint", F.sha2("form", 256).alias("bytes_sha256"), "class_id", "members")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Operator 2 with each document's class: ``class_id`` and ``members``, null and 1 for a text without equals."""
    groups = materialise(classes(docs), "classes")
    found = fingerprint_with_edits(docs).join(groups, ["fingerprint", "bytes_sha256"], "left")
    return found.withColumn("members", F.coalesce("members", F.lit(1))).drop("bytes_sha256")
