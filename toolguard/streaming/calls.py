"""Streams of calls: decisions, and counts by action over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolguard.operators.policy import decide
from toolguard.sources import tables

WINDOW, LATENESS = "1 hour", "10 minutes"


def decide_stream(calls: DataFrame, policy: dict, path: str, checkpoint: str):
    """Decide every call of a stream and append the audit; returns the unstarted query.

    The decision is a projection, so a batch holds no state and can be replayed.
    """
    return tables.stream_audit(decide(calls, policy), path, checkpoint)


def action_counts(decisions: DataFrame, window: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Decisions by action in tumbling windows of call time.

    The watermark bounds the state to open windows; later calls are dropped.
    On a batch the same function is an ordinary aggregation.
    """
    return (
        decisions.withWatermark("call_ts", lateness)
        .groupBy(F.window("call_ts", window), "action")
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "action", "calls")
    )


def count_stream(counts: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write finished windows (``append``), or every change by batch (``update``)."""
    writer = counts.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        return writer.format("parquet").option("path", path)

    def save(batch: DataFrame, batch_id: int) -> None:
        # Overwriting its own folder makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return writer.foreachBatch(save)


def latest_counts(changes: DataFrame) -> DataFrame:
    """Current counts from a log of changes: the last batch of a window counts."""
    return (
        changes.groupBy("window_start", "window_end", "action")
        .agg(F.max_by("calls", "batch_id").alias("calls"))
    )


def compact_counts(spark: SparkSession, path: str, target: str) -> None:
    """Write the current counts of a long log of changes as a single batch of a new one."""
    latest_counts(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{target}/batch_id=0")
