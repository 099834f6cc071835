"""Unbounded inputs by Structured Streaming: the batch operators that have a streaming meaning.

State is bounded by watermarks everywhere; rows later than the delay are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed(events: DataFrame, time: str, width: str, keys: list[str], delay: str, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by time window and keys; a window is final once the watermark has passed it."""
    at = F.col(time).cast("timestamp")
    frame = F.window("__at", width, slide) if slide else F.window("__at", width)
    out = events.withColumn("__at", at).withWatermark("__at", delay).groupBy(frame.alias("window"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def first_of_key(events: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """Each key's first row within the watermark."""
    return events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", delay).dropDuplicatesWithinWatermark(keys).drop("__at")


def interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, key: str, within: str, delay: str) -> DataFrame:
    """Pairs of one key whose right time lies within the interval before the left one. Right columns must differ in name."""
    a = left.withColumn("__left", F.col(left_time).cast("timestamp")).withWatermark("__left", delay)
    b = right.withColumn("__right", F.col(right_time).cast("timestamp")).withWatermark("__right", delay).withColumnRenamed(key, "__key")
    near = (F.col("__right") <= F.col("__left")) & (F.col("__right") >= F.col("__left") - F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col("__key")) & near).drop("__left", "__right", "__key")


def run_once(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, to Parquet, exactly once across restarts."""
    query = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
