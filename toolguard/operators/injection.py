"""Descriptions that talk to the agent instead of describing the tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import regex
from toolguard.functions.constants import constant, constant_map, let
from toolguard.scale import unnest

FINDING = "struct<type:string,detail:string,confidence:string,severity:string,matched_text:string>"
LOWERED_CONFIDENCE = {"HIGH": "MEDIUM", "MEDIUM": "LOW"}


def _finding(kind: str, detail, confidence, severity, matched) -> Column:
    def column(value):
        return F.lit(value) if isinstance(value, str) else value

    return F.struct(
        F.lit(kind).alias("type"),
        column(detail).alias("detail"),
        column(confidence).alias("confidence"),
        column(severity).alias("severity"),
        column(matched).alias("matched_text"),
    )


def instruction_phrase(description: Column) -> Column:
    """The first *listed* phrase that occurs, as a finding (NULL if none does)."""
    return let(F.lower(description), _first_phrase)


def _first_phrase(lowered: Column) -> Column:
    framed = regex.any_of(lowered, rules.LEGITIMATE_FRAMING)
    phrases = [
        {
            "pattern": regex.java(pattern),
            "hint": regex.hint(pattern),
            "plain": confidence,
            "framed": LOWERED_CONFIDENCE.get(confidence, confidence),
            "detail": explanation,
        }
        for pattern, confidence, explanation in rules.INSTRUCTION_PHRASES
    ]
    return let(
        regex.first_rule(phrases, lowered),
        lambda r: F.when(
            r.isNotNull(),
            _finding(
                "Suspicious instruction phrase", r["detail"], F.when(framed, r["framed"]).otherwise(r["plain"]),
                r["plain"], regex.found(lowered, r["pattern"], 0),
            ),
        ),
    )


def hidden_characters(description: Column) -> Column:
    """A zero-width character; the first listed one that occurs is reported."""
    shown = constant_map({ch: f"'\\u{ord(ch):04x}'" for ch in rules.ZERO_WIDTH})
    first = F.get(F.filter(constant(rules.ZERO_WIDTH), lambda c: F.contains(description, c)), F.lit(0))
    hidden = description.rlike(f"[{''.join(rules.ZERO_WIDTH)}]")
    return F.when(
        hidden, _finding("Hidden characters", rules.HIDDEN_TEXT, "HIGH", "HIGH", F.try_element_at(shown, first))
    )


def long_description(description: Column) -> Column:
    """A description of more than 800 characters."""
    n = F.length(description)
    before, after = rules.LONG_TEXT.split("{n}")
    detail = F.concat(F.lit(before), n.cast("string"), F.lit(after))
    matched = F.concat(F.lit("length="), n.cast("string"))
    return F.when(
        n > rules.LONG_DESCRIPTION,
        _finding("Unusually long description", detail, "MEDIUM", "MEDIUM", matched),
    )


def findings(description: Column) -> Column:
    """All findings of one description: at most three, in a fixed order."""
    return F.array_compact(
        F.array(
            instruction_phrase(description), hidden_characters(description), long_description(description)
        )
    )


def injection_findings(tools: DataFrame) -> DataFrame:
    """One row per finding, with the tool it is about."""
    found = unnest(tools, ["repo_id", "file", "seq", "name"], findings(F.col("description")), "f")
    return found.select("repo_id", "file", "seq", F.col("name").alias("tool"), "f.*")
