"""A session with the settings these jobs count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Whole files travel to Python workers: keep batches small in bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def build(name: str = "toolguard", **settings: str) -> SparkSession:
    """A session; master and cluster settings come from outside, as with spark-submit."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
