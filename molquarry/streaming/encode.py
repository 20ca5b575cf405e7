"""Encoders and counts over file streams (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 day", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """(window_start, by..., n, total) with a watermark; naive timestamps are cast first."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = timed.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available into a table and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """The same operators as on tables, over micro-batches."""
    stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
