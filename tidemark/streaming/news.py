"""Sliding count of events by key over 48 hours, as a stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.shared import file_stream, run_to_end


def windowed_counts(stream: DataFrame, key: str, ts: str = "ts", width: str = "48 hours", slide: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, width).groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def news_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, run to its end. The state is one row a window and key, as the result."""
    stream = file_stream(spark, f"{sf_dir}/events.parquet")
    return run_to_end(windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "event_type"), "news")
