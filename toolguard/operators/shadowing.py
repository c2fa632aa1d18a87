"""Tools that take the name, or the calls, of another tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import regex
from toolguard.functions.constants import let
from toolguard.scale import hottest, salted_join, unnest

def redirect(description: Column) -> Column:
    """The first *listed* redirect phrase, as a finding (NULL if there is none)."""
    start, middle, end = _split(rules.REDIRECT_TEXT, ["{explanation}", "{referenced}"])
    phrases = [
        {
            "pattern": regex.java(pattern, ignore_case=True),
            "hint": regex.hint(pattern),
            "confidence": confidence,
            "before": start + explanation + middle,
        }
        for pattern, confidence, explanation in rules.REDIRECT_PHRASES
    ]

    def finding(r: Column) -> Column:
        return F.struct(
            F.lit("Redirect language").alias("type"),
            F.concat(r["before"], regex.found(description, r["pattern"], 1), F.lit(end)).alias("detail"),
            r["confidence"].alias("confidence"),
            F.lit("HIGH").alias("severity"),
            regex.found(description, r["pattern"], 0).alias("matched_text"),
            regex.found(description, r["pattern"], 1).alias("referenced_tool"),
        )

    first = let(regex.folded(description), lambda literal: regex.first_rule(phrases, description, literal))
    return let(first, lambda r: F.when(r.isNotNull(), finding(r)))


def redirects(description: Column) -> Column:
    """True where any redirect phrase occurs."""
    return regex.any_of(description, [p for p, _, _ in rules.REDIRECT_PHRASES], ignore_case=True)


def redirect_findings(tools: DataFrame) -> DataFrame:
    """One row per tool whose description redirects calls to it."""
    return (
        unnest(tools, ["repo_id", "file", "seq", "name"], F.array(redirect(F.col("description"))), "f")
        .select("repo_id", "file", "seq", F.col("name").alias("tool"), "f.*")
    )


def _per_file(tools: DataFrame) -> DataFrame:
    return tools.groupBy("repo_id", "name", "file").agg(F.count(F.lit(1)).alias("registrations"))


def duplicate_names(tools: DataFrame) -> DataFrame:
    """Names registered more than once in a repo, with registration and file counts.

    Counting per file first keeps each step a combinable count, so a name that
    holds a large share of all tools is never gathered in one place.
    """
    return (
        _per_file(tools)
        .groupBy("repo_id", "name")
        .agg(F.sum("registrations").alias("registrations"), F.count(F.lit(1)).alias("files"))
        .where(F.col("registrations") > 1)
    )


def duplicate_files(tools: DataFrame) -> DataFrame:
    """Every file that registers a duplicated name: the whole list, as rows."""
    names = duplicate_names(tools)
    return salted_join(
        _per_file(tools), names.select("repo_id", "name"), ["repo_id", "name"], "left_semi",
        spread=["file"], hot=hottest(names, "files"),
    )


def duplicate_findings(tools: DataFrame) -> DataFrame:
    """One finding per duplicated name; ``duplicate_files`` holds every file of every name."""
    start, middle, end, tail = _split(rules.DUPLICATE_TEXT, ["{name}", "{n}", "{files}"])
    n, files = F.col("registrations").cast("string"), F.concat(F.col("files").cast("string"), F.lit(" files"))
    detail = F.concat(F.lit(start), F.col("name"), F.lit(middle), n, F.lit(end), files, F.lit(tail))
    return duplicate_names(tools).select(
        "repo_id",
        F.col("name").alias("tool"),
        F.lit("Duplicate tool name").alias("type"),
        detail.alias("detail"),
        F.lit("MEDIUM").alias("confidence"),
        F.lit("HIGH").alias("severity"),
        F.concat(n, F.lit(" registrations across "), files).alias("matched_text"),
        "registrations",
        "files",
    )


def _split(text: str, marks: list[str]) -> list[str]:
    parts = []
    for mark in marks:
        before, text = text.split(mark, 1)
        parts.append(before)
    return [*parts, text]


def shadowing_findings(tools: DataFrame) -> DataFrame:
    """Duplicate names and redirects in one list of findings."""
    common = ["repo_id", "tool", "type", "detail", "confidence", "severity", "matched_text"]
    return (
        duplicate_findings(tools)
        .select(*common, F.lit(None).cast("string").alias("referenced_tool"))
        .unionByName(redirect_findings(tools).select(*common, "referenced_tool"))
    )


def shadowing_by_name(tools: DataFrame) -> DataFrame:
    """Per name: registrations, and how many redirects *any* tool of that name has.

    A report entry carries the findings of its name, so each of n tools would
    repeat all n redirects.  The counts say the same; the findings stay in
    their own table, once each.
    """
    return (
        tools.select("repo_id", "name", redirects(F.col("description")).cast("long").alias("r"))
        .groupBy("repo_id", "name")
        .agg(F.count(F.lit(1)).alias("registrations"), F.sum("r").alias("redirects"))
        .where((F.col("registrations") > 1) | (F.col("redirects") > 0))
        .withColumn(
            "shadowing_count", F.when(F.col("registrations") > 1, 1).otherwise(0) + F.col("redirects")
        )
    )
