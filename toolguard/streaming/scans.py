"""Streams of scan results: the latest score per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toolguard.operators import history


def store_stream(scans: DataFrame, path: str, checkpoint: str):
    """Append each batch's last score per key to the store; returns the unstarted query.

    The store is a log of small, already reduced batches, each in a folder of
    its own that a repeated batch overwrites.  Nothing is rewritten and no
    state is kept, however many repositories there are.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        history.latest(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return scans.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)


def latest_scores(spark: SparkSession, path: str) -> DataFrame:
    """The stored state: the last score of every key in the log."""
    return history.latest(spark.read.parquet(path))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the state of a long log as a single batch of a new one."""
    latest_scores(spark, path).write.mode("overwrite").parquet(f"{target}/batch_id=0")
