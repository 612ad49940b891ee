"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset it is set once in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_written = threading.local()


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Removes a table that ``materialise`` returned and that nothing reads any more."""
    _remove(table.sparkSession, table._written_to)


@contextmanager
def keeping_last(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``materialise`` writes inside, but for the last one, which must hold all that is needed of the others."""
    scopes = _written.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        paths = scopes.pop()
        for path in paths[:-1]:
            _remove(spark, path)
        if scopes:
            scopes[-1] += paths[-1:]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back, which cuts its lineage; the shuffle files that it took are removed once it is written."""
    spark = df.sparkSession
    path = scratch_uri(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    if scopes := getattr(_written, "scopes", None):
        scopes[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, so that it may be broadcast; of a written table only footers are read."""
    return df.count() <= max_rows
