"""The report: one row per tool with everything found about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import capabilities as caps
from toolguard.functions import risk
from toolguard.functions.constants import constant
from toolguard.operators import attach, blast, guidance, injection, permissions, shadowing


def score() -> Column:
    """RED, YELLOW or GREEN from the findings in the row."""
    high = [c for c, severity in rules.MISMATCH_SEVERITY.items() if severity == "HIGH"]
    red = (
        (F.size("injection_findings") > 0)
        | (F.col("shadowing_count") > 0)
        | (F.col("static_serious") > 0)
        | F.arrays_overlap("mismatches", constant(high))
        | (F.col("risk_level") == "CRITICAL")
    )
    # Any other mismatch is MEDIUM or LOW; either way the tool is YELLOW.
    yellow = (F.size("mismatches") > 0) | (F.col("static_findings") > 0) | (F.col("risk_level") != "LOW")
    return F.when(red, "RED").when(yellow, "YELLOW").otherwise("GREEN")


def with_behavior(tools: DataFrame) -> DataFrame:
    """Add language, behavior flags and the flags its description leaves out.

    ``tools`` has ``file_flags``, from ``attach_file_flags`` or from extraction.
    """
    return (
        tools.withColumn("language", caps.language(F.col("file")))
        .withColumn(
            "actual_behavior",
            attach.behavior_flags(F.col("code_snippet"), F.col("file"), F.col("file_flags")),
        )
        .withColumn("mismatches", caps.unmentioned(F.col("actual_behavior"), F.col("description")))
    )


def with_row_findings(tools: DataFrame) -> DataFrame:
    """Add all that a row tells by itself: risk, injection, permissions, blast radius."""
    text, level = F.col("__text"), F.col("risk_level")
    described = permissions.analyze(
        tools.withColumns(
            {
                "__text": risk.searchable(F.col("name"), F.col("description")),
                "injection_findings": injection.findings(F.col("description")),
            }
        ).withColumn("risk_level", risk.level(text))
    )
    return described.withColumns(
        {
            "risk_keyword": risk.keyword(text, level),
            "risk_explanation": risk.explanation(level),
            "risk_prevention": guidance.risk_prevention(level),
            "blast_radius": blast.blast_radius(text, F.col("actual_behavior"), level),
        }
    )


def tool_report(tools: DataFrame, static_findings: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The whole report for tools that carry ``file_flags``."""
    behaving = with_behavior(tools)
    if verdicts is not None:
        behaving = attach.confirmed_mismatches(behaving, verdicts)
    joined = attach.attach_static(behaving, static_findings)
    joined = attach.attach_shadowing(joined, shadowing.shadowing_by_name(tools))
    found = with_row_findings(joined).withColumn("score", score())
    injected, shadowed = F.size("injection_findings") > 0, F.col("shadowing_count") > 0
    return found.select(
        "repo_id", "file", "seq", "name", "description", "language", "actual_behavior", "mismatches",
        F.transform("mismatches", guidance.capability_guidance).alias("mismatch_impacts"),
        "static_findings", "static_serious",
        "risk_level", "risk_keyword", "risk_explanation", "risk_prevention",
        "injection_findings",
        F.when(injected, guidance.finding_guidance("injection")).alias("injection_impact"),
        "registrations", "redirects", "shadowing_count",
        F.when(shadowed, guidance.finding_guidance("shadowing")).alias("shadowing_impact"),
        "permission_matrix", "permission_severity", "permission_findings",
        "blast_radius", "score",
    )


def scan_counts(report: DataFrame) -> DataFrame:
    """Per repo: tools, and how many of them are RED, YELLOW and GREEN."""
    return report.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("tools"),
        *[F.count_if(F.col("score") == s).alias(s.lower()) for s in ("RED", "YELLOW", "GREEN")],
    )
