"""Screening of a stream: confusion counts per event-time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.metrics import confusion_counts
from ..session import scratch_path


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet file, or the files of a folder, as a stream under the schema they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern: a path without one must be a folder
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def windowed_confusion(events: DataFrame, time: str, predicted: Column, actual: Column, window: str, delay: str) -> DataFrame:
    """(window_start, counts of the four outcomes) per event-time window, of a stream or a table.

    State is one row per open window. A window is closed once it lies ``delay``
    before the latest event of the batches before; rows that come for it later are
    left out, rows that are less late never. Rows without a time belong to no window.
    """
    marked = events.select(F.col(time).cast("timestamp").alias("__time"), predicted.cast("int").alias("predicted"), actual.cast("int").alias("actual"))
    timed = marked.withWatermark("__time", delay).withColumn("__window", F.window("__time", window))
    return confusion_counts(timed.where("__time is not null"), ["__window"]).withColumn("window_start", F.col("__window.start")).drop("__window")


def run_available(stream: DataFrame, key: list[str]) -> DataFrame:
    """Run an aggregated stream over all input that is there; the newest row of each key.

    Each micro-batch replaces its own folder, so one that is run again after a
    failure changes nothing, and windows that are still open are returned too.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    write(spark.createDataFrame([], stream.schema), -1)  # a stream without files runs no batch
    query = stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = "batch bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    rows = spark.read.schema(schema).parquet(out)
    values = [c for c in stream.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("__row"))
    return newest.select(*key, *[F.col(f"__row.{c}").alias(c) for c in values]).select(*stream.columns)
