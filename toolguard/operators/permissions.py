"""Declared against actual capabilities of tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import capabilities as caps
from toolguard.functions.constants import let
from toolguard.scale import unnest


def matrix(actual: Column, declared: Column) -> Column:
    """Compare two capability sets; every list in it is sorted."""
    sets = F.struct(
        F.sort_array(declared).alias("declared"),
        F.sort_array(actual).alias("actual"),
        F.sort_array(F.array_except(actual, declared)).alias("undisclosed"),
        F.sort_array(F.array_except(declared, actual)).alias("extra"),
        F.size(F.array_union(actual, declared)).alias("active"),
    )
    return let(
        sets,
        lambda s: F.struct(
            s["declared"].alias("declared"),
            s["actual"].alias("actual"),
            s["undisclosed"].alias("undisclosed_actual"),
            s["extra"].alias("extra_declared"),
            F.when((s["active"] > 1) & (F.size(s["declared"]) == 0), s["actual"]).otherwise(caps.no_flags()).alias("excessive"),
            s["active"].alias("permission_count"),
            (F.size(s["undisclosed"]) > 0).alias("has_undisclosed"),
            (F.size(s["extra"]) > 0).alias("has_extra_declared"),
        ),
    )


def severity(undisclosed: Column) -> Column:
    """The worst severity of the undisclosed capabilities, else LOW."""
    high = [c for c, s in rules.UNDISCLOSED_SEVERITY.items() if s == "HIGH"]
    is_high = F.exists(undisclosed, lambda c: c.isin(high))
    return F.when(is_high, "HIGH").when(F.size(undisclosed) > 0, "MEDIUM").otherwise("LOW")


def findings(permission_matrix: Column) -> Column:
    """Undisclosed capabilities, then inflated declarations."""

    def entry(kind: str, text: str, level):
        before, after = text.split("{what}")
        return lambda c: F.struct(
            F.lit(kind).alias("type"),
            c.alias("category"),
            level(c).alias("severity"),
            F.concat(F.lit(before), caps.lookup(c, rules.CAPABILITY_TEXT), F.lit(after)).alias("detail"),
            c.alias("capability"),
        )

    return F.concat(
        F.transform(
            permission_matrix["undisclosed_actual"],
            entry("Undisclosed capability", rules.UNDISCLOSED_TEXT, lambda c: caps.lookup(c, rules.UNDISCLOSED_SEVERITY)),
        ),
        F.transform(
            permission_matrix["extra_declared"],
            entry("Inflated declaration", rules.INFLATED_TEXT, lambda c: F.lit("LOW")),
        ),
    )


def actual_capabilities(snippet: Column, file_flags: Column) -> Column:
    """Both rule sets on a snippet ('' has none); without a snippet, the file's flags."""
    return F.when(snippet.isNotNull(), caps.either_flags(snippet)).otherwise(
        F.coalesce(file_flags, caps.no_flags())
    )


def analyze(tools: DataFrame) -> DataFrame:
    """Add ``permission_matrix``, ``permission_severity`` and ``permission_findings``.

    ``tools`` has a ``file_flags`` column for tools that come without a snippet.
    """
    sets = {
        "__actual": actual_capabilities(F.col("code_snippet"), F.col("file_flags")),
        "__declared": caps.declared(F.col("description")),
    }
    results = {
        "permission_severity": severity(F.col("permission_matrix.undisclosed_actual")),
        "permission_findings": findings(F.col("permission_matrix")),
    }
    return (
        tools.withColumns(sets)
        .withColumn("permission_matrix", matrix(F.col("__actual"), F.col("__declared")))
        .withColumns(results)
        .drop("__actual", "__declared")
    )


def permission_findings(analyzed: DataFrame) -> DataFrame:
    """One row per permission finding."""
    found = unnest(analyzed, ["repo_id", "file", "seq", "name"], F.col("permission_findings"), "f")
    return found.select(
        "repo_id", "file", "seq", F.col("name").alias("tool"), "f.type", "f.category", "f.severity", "f.detail"
    )


def last_by_name(analyzed: DataFrame) -> DataFrame:
    """One analysis per repo and name; the last registered tool of a name wins."""
    order = F.struct(F.when(F.col("language") == "Python", 0).otherwise(1), "file", "seq")
    return (
        analyzed.groupBy("repo_id", "name")
        .agg(
            F.max_by(
                F.struct(
                    "permission_severity",
                    F.col("permission_matrix.actual").alias("actual"),
                    F.col("permission_matrix.declared").alias("declared"),
                ),
                order,
            ).alias("a")
        )
        .select("repo_id", "name", F.col("a.permission_severity").alias("severity"), "a.actual", "a.declared")
    )
