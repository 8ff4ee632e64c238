"""Streaming extension: windows and running outlier flags over event streams (batch sources have the same columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_statistics(events: DataFrame, window: str = "1 day", slide: str | None = None, watermark: str = "2 days") -> DataFrame:
    """Per event type and tumbling or sliding window: count, mean, standard deviation; late rows beyond the watermark are dropped by the engine."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", watermark).groupBy(w, "event_type")
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "mean", "sd")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "2 days") -> DataFrame:
    """Activity sessions per user."""
    g = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n", "total")


def flag_against(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Events flagged against static per-type bounds (feature_id, lower, upper): a stream-static join, broadcast if small."""
    b = bounds.select(F.col("feature_id").alias("event_type"), "lower", "upper")
    return events.join(b, "event_type", "left").withColumn("outlier", F.coalesce((F.col("value") > F.col("upper")) | (F.col("value") < F.col("lower")), F.lit(False))).drop("lower", "upper")
