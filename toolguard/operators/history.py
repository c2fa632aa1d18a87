"""Stored scan scores: an append-only log and its latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolguard.operators import urls


def with_key(scans: DataFrame, url: str = "url") -> DataFrame:
    """Scans keyed by their repository's store key."""
    return scans.withColumn("repo_key", urls.repo_key(F.col(url)))


def latest(scans: DataFrame) -> DataFrame:
    """The last written score per key: a combinable ``max_by``, one row per key."""
    last = F.max_by(F.struct("score", "scanned_at", "seq"), F.struct("scanned_at", "seq")).alias("last")
    return scans.groupBy("repo_key").agg(last).select("repo_key", "last.score", "last.scanned_at", "last.seq")


def lookup(scans: DataFrame, wanted: DataFrame, url: str = "url") -> DataFrame:
    """The latest score of each wanted URL, UNKNOWN where none is stored."""
    keyed = with_key(wanted, url)
    return keyed.join(latest(scans), "repo_key", "left").withColumn(
        "score", F.coalesce("score", F.lit("UNKNOWN"))
    )
