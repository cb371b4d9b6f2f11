"""Speech-like regions and running profiles over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events of Parquet files in a folder as a stream; ts is cast, as watermarks need a time zone."""
    schema = spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def session_regions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Regions of events less than a gap apart; the same on a batch and on a stream, where the
    watermark closes regions and drops what is later."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "value")


def tumbling_chunks(events: DataFrame, width: str = "30 seconds", late: str = "1 hour") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("start"), "event_type", "n_events")


def running_profiles(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Counts so far per key and type; for update or complete output."""
    return events.groupBy(key, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
