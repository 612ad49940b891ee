"""Streaming forms of the incremental operators: telemetry windows and corpus refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import refreshed


def stage_windows(events: DataFrame, moment: str, stage: str, value: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count, mean and largest value of each stage and window; later events than ``late`` are dropped."""
    grouped = events.withWatermark(moment, late).groupBy(F.window(moment, width), stage)
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), stage, "n", "mean", "most")


def read_events(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def keep_fresh(changes: DataFrame, target: str, checkpoint: str, key: str, digest: str, newest: str | None = None) -> StreamingQuery:
    """Apply every micro-batch of ``(key, digest, ...)`` to the table at ``target``, in numbered versions.

    Of several changes of a key in a batch the one with the greatest ``newest`` counts (without that column the one with the greatest digest).

    A batch that is replayed after a failure writes the same version again from the same predecessor.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        row = F.max_by(F.struct(*batch.columns), F.struct(*([F.col(newest)] if newest else []), F.col(digest)))
        latest = batch.groupBy(F.col(key).alias("_key")).agg(row.alias("_row")).select("_row.*")
        if number == 0:
            state = latest
        else:
            before = spark.read.parquet(f"{target}/version={number - 1}")
            untouched = before.join(latest.select(key), key, "left_anti")
            touched = before.join(latest.select(key), key, "left_semi")
            state = untouched.unionByName(refreshed(touched, latest, key, digest))
        state.write.mode("overwrite").parquet(f"{target}/version={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
