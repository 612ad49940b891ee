"""A keyed table in buckets, of which a refresh rewrites only those that it touches.

Layout below ``path``: ``data/version=<n>/bucket=<b>`` holds rows, ``manifest/version=<n>`` one row a bucket: the version that holds it, its
rows and a digest of its keys and contents. A refresh reads and writes the buckets of new, changed and stale keys, and a manifest
that points to older versions for all others; readers of an older manifest are not disturbed. The same version written again from the same
predecessor is the same, so a replayed batch does no harm. Buckets are taken from the MD5 of the key; their number is fixed when the
index is made, and bounds the manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.storage import materialise

Encoder = Callable[[DataFrame], DataFrame]


def bucket(key: str, buckets: int) -> Column:
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("int") % buckets


def manifest(spark: SparkSession, path: str, version: int) -> list:
    return spark.read.parquet(f"{path}/manifest/version={version}").orderBy("bucket").collect()


def read_index(spark: SparkSession, path: str, version: int, only: list[int] | None = None) -> DataFrame:
    """The rows of a version (of some buckets), each bucket from the version that holds it."""
    rows = [r for r in manifest(spark, path, version) if r["rows"] and (only is None or r["bucket"] in only)]
    schema = spark.read.parquet(f"{path}/schema")
    if not rows:
        return schema.limit(0)
    return spark.read.schema(schema.schema).parquet(*[f"{path}/data/version={r['version']}/bucket={r['bucket']}" for r in rows])


def latest(batch: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """One row a key: the one with the greatest ``newest``."""
    row = F.max_by(F.struct(*batch.columns), F.struct(*newest))
    return batch.groupBy(F.col(key).alias("_key")).agg(row.alias("_row")).select("_row.*")


def refresh(path: str, version: int, changes: DataFrame, key: str, digest: str, encode: Encoder | None = None, buckets: int = 256, whole: bool = False) -> DataFrame:
    """Write ``version`` of the index from ``version - 1`` (none before 1) and ``changes``; gives ``bucket, rows, added, changed, removed, rewritten``.

    ``changes`` has one row a key: the key, the digest of its content, whatever ``encode`` needs, and maybe ``deleted``. Rows whose digest is in
    the index already are neither encoded nor written again. With ``whole`` the changes are the whole corpus, and other keys go.
    """
    spark = changes.sparkSession
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
    wanted = changes.withColumns({"_bucket": bucket(key, buckets), "_gone": gone})
    before = {r["bucket"]: r for r in manifest(spark, path, version - 1)} if version > 1 else {}
    if version > 1:
        held = read_index(spark, path, version - 1).select(F.col(key), F.col(digest).alias("_held"))
        both = wanted.select(key, digest, "_bucket", "_gone").join(held, key, "full" if whole else "left")
    else:
        both = wanted.select(key, digest, "_bucket", "_gone").withColumn("_held", F.lit(None).cast("string"))
    fate = F.when(F.col("_held").isNull() & F.coalesce(~F.col("_gone"), F.lit(False)), "added").when(F.col("_held").isNotNull() & F.coalesce(F.col("_gone"), F.lit(True)), "removed").when(F.col("_held") != F.col(digest), "changed")
    fates = materialise(both.select(key, F.coalesce("_bucket", bucket(key, buckets)).alias("_bucket"), fate.alias("fate")).where("fate is not null"), "fates")
    counts = {r["_bucket"]: r for r in fates.groupBy("_bucket").agg(*[F.count_if(F.col("fate") == f).alias(f) for f in ("added", "changed", "removed")]).collect()}  # a row a bucket
    fresh = wanted.join(fates.where("fate <> 'removed'").select(key), key, "left_semi").drop("_gone", "_bucket", "deleted")
    fresh = encode(fresh) if encode else fresh
    if version > 1:
        stay = read_index(spark, path, version - 1, list(counts)).join(fates.select(key), key, "left_anti")
        rows = stay.unionByName(fresh.select(stay.columns))
    else:
        rows = fresh
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    target = f"{path}/data/version={version}"
    rows.withColumn("bucket", bucket(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    sized = {r["bucket"]: r for r in _contents(spark, target, rows, key, digest, buckets).collect()} if counts else {}
    out = []
    for b in range(buckets):
        old, new = before.get(b), sized.get(b)
        if b in counts:
            out.append((b, version, new["rows"] if new else 0, new["snapshot"] if new else ""))
        else:
            out.append((b, old["version"], old["rows"], old["snapshot"]) if old else (b, version, 0, ""))
    table = spark.createDataFrame(out, "bucket int, version int, rows long, snapshot string").coalesce(1)
    table.write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    report = [(b, n, *(int(counts[b][f]) if b in counts else 0 for f in ("added", "changed", "removed")), b in counts) for b, _, n, _ in out]
    return spark.createDataFrame(report, "bucket int, rows long, added long, changed long, removed long, rewritten boolean")


def _contents(spark: SparkSession, target: str, rows: DataFrame, key: str, digest: str, buckets: int) -> DataFrame:
    """Rows of each written bucket and a digest of its set of keys and contents: sums of parts of the rows' hashes, whatever their order."""
    written = spark.read.schema(rows.schema).parquet(target)
    line = F.sha2(F.concat_ws("=", F.col(key).cast("string"), F.col(digest)), 256)
    sums = [F.sum(F.conv(F.substring(line, 1 + 14 * k, 14), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return written.groupBy(bucket(key, buckets).alias("bucket")).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", *sums), 256).alias("snapshot"))


def snapshot(spark: SparkSession, path: str, version: int) -> str:
    """A digest of a version's keys and contents, the same for equal contents whatever their history."""
    return hashlib.sha256("\n".join(f"{r['bucket']}:{r['snapshot']}" for r in manifest(spark, path, version)).encode()).hexdigest()


def keep_index(changes: DataFrame, path: str, checkpoint: str, key: str, digest: str, newest: list[str], encode: Encoder | None = None, buckets: int = 256) -> StreamingQuery:
    """Apply every micro-batch of changes to the index; batch n writes version n + 1."""

    def apply(batch: DataFrame, number: int) -> None:
        refresh(path, number + 1, latest(batch, key, newest), key, digest, encode, buckets)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

