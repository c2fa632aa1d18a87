"""Inherent risk of a tool, from the words in its name and description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import regex
from toolguard.functions.capabilities import lookup
from toolguard.functions.constants import constant, let

LEVELS = ("CRITICAL", "HIGH", "MEDIUM")


def searchable(name: Column, description: Column) -> Column:
    """Lowercased ``name description`` with ``_`` and ``-`` as spaces."""
    text = F.lower(F.concat(name, F.lit(" "), description))
    return F.replace(F.replace(text, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))


def level(text: Column) -> Column:
    """Risk level of a searchable text: one search for all words, more only where it hits."""
    case = F.when(~text.rlike(_words(*LEVELS)), "LOW")
    for name in LEVELS:
        case = case.when(text.rlike(_words(name)), name)
    return case.otherwise("LOW")


def keyword(text: Column, risk_level: Column) -> Column:
    """The first listed word of the level that occurs (NULL for LOW).

    One more search lists the level's words in the text; no word of a level
    lies inside another one, so none hides another.
    """
    case = F
    for name in LEVELS:
        case = case.when(risk_level == name, _first_word(text, name))
    return case


def _first_word(text: Column, name: str) -> Column:
    words = constant([{"word": w, "spaced": w.replace("_", " ")} for w in rules.RISK_WORDS[name]])
    present = F.regexp_extract_all(text, F.lit(_words(name)), F.lit(0))
    return let(present, lambda p: F.get(F.filter(words, lambda w: F.array_contains(p, w["spaced"])), F.lit(0)))["word"]


def explanation(risk_level: Column) -> Column:
    return lookup(risk_level, rules.RISK_TEXT)


def _words(*levels: str) -> str:
    return regex.whole_word([w.replace("_", " ") for name in levels for w in rules.RISK_WORDS[name]])
