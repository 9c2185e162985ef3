"""Usage events as a stream: sums by tool, provider and window of time, and sessions. An extension of the batch summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.telemetry import SUMS

SCHEMA = "event_id long, created_at timestamp, tool string, provider string, query string, target_path string, result_count long, candidate_files long, returned_files long, estimated_saved_tokens long"


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events as they are appended to a table of Parquet files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, tool, provider, events and sums; an event later than the watermark doesn't change what was told."""
    sums = events.withWatermark("created_at", late).groupBy(F.window("created_at", every), "tool", "provider").agg(F.count("*").alias("events"), *(F.sum(c).alias(c) for c in SUMS))
    return sums.select(F.col("window.start").alias("window_start"), "tool", "provider", "events", *SUMS)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, provider, events of runs of events no further apart than ``gap``."""
    rows = events.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap), "provider").agg(F.count("*").alias("events"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "provider", "events")
