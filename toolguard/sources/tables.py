"""Readers and writers of calls, policies, analyzer output, reports and audits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from toolguard import schemas
from toolguard.operators import policy as policies


# ----------------------------------------------------------------------- calls
def read_calls(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Calls from JSON arrays (``multiline``) or from one object per line."""
    return spark.read.schema(schemas.CALLS).option("multiLine", multiline).json(path)


def stream_calls(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.CALLS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


# -------------------------------------------------------------------- policies
def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def read_policy(spark: SparkSession, path: str) -> dict:
    """One policy from a JSON file; what is absent stays absent."""
    rows = spark.read.schema(schemas.POLICY).option("multiLine", True).json(path).take(2)
    if not rows:
        raise ValueError(f"no policy in {path}")
    if len(rows) > 1:
        raise ValueError(f"more than one policy in {path}")
    return policies.validated(_plain(rows[0]))


def policy_json(policy: dict) -> str:
    return json.dumps(policy, indent=2)


def policy_from_json(text: str) -> dict:
    return policies.validated(json.loads(text))


def policy_rules(spark: SparkSession, policy: dict) -> DataFrame:
    """The rules as a table, in order."""
    text = json.dumps([{**r, "rule_ord": i} for i, r in enumerate(policy.get("rules", []))])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), schemas.POLICY_RULES)))


# ------------------------------------------------------------- static analysis
def read_static_findings(spark: SparkSession, path: str, repo_id: str, multiline: bool = True) -> DataFrame:
    """Findings from an analyzer's JSON output, one document a file or one a line; those without a path are dropped.

    Paths stay as written; ``attach.static_by_file`` and its kin take the root that they lie below.
    """
    found = spark.read.schema(schemas.ANALYZER_OUTPUT).option("multiLine", multiline).json(path)
    return static_findings(found.withColumn("repo_id", F.lit(repo_id)))


def static_findings(output: DataFrame) -> DataFrame:
    """Analyzer output with a ``results`` array as flat findings, with defaults."""
    return (
        output.select("repo_id", F.explode("results").alias("r"))
        .where(F.coalesce("r.path", F.lit("")) != "")
        .select(
            "repo_id",
            "r.path",
            F.col("r.start.line").alias("line"),
            F.coalesce("r.extra.message", F.lit("No message")).alias("message"),
            F.coalesce("r.extra.severity", F.lit("INFO")).alias("severity"),
        )
    )


# ---------------------------------------------------------------------- outputs
def write_report(report: DataFrame, path: str, file_format: str = "json", buckets: int | None = None) -> None:
    """Write a report; ``buckets`` groups repos into that many folders.

    A folder per repo would mean one tiny file per task and repo; hashing repos
    into a fixed number of folders keeps pruning and file sizes.
    """
    writer = report
    if buckets:
        writer = report.withColumn("repo_bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets)))
    sink = writer.write.mode("overwrite").format(file_format)
    (sink.partitionBy("repo_bucket") if buckets else sink).save(path)


def audit_entries(decisions: DataFrame) -> DataFrame:
    """Decisions as audit rows; the time is that of the call, never the clock's."""
    return decisions.select(
        "call_ts", F.to_date("call_ts").alias("call_date"), "call_id", "action", "rule", "reason", "severity",
        F.col("tool_name"), "logged_arguments",
    )


def append_audit(decisions: DataFrame, path: str) -> None:
    audit_entries(decisions).write.mode("append").partitionBy("call_date").parquet(path)


def stream_audit(decisions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append-only audit of a stream of decisions, exactly once per call.

    A batch is clustered by date first, so that it writes a file per date rather than one per task and
    date; dates with many calls are cut. It overwrites its own folder if it is repeated.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.hint("rebalance", "call_date")
        rows.write.mode("overwrite").partitionBy("call_date").parquet(f"{path}/batch_id={batch_id}")

    return audit_entries(decisions).writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
