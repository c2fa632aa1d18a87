"""Behavior flags of code and capabilities claimed by descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import regex
from toolguard.functions.constants import constant, constant_map, let


def is_js(path: Column) -> Column:
    """True for the six script extensions, in any letter case."""
    ends = "|".join(e.lstrip(".") for e in rules.JS_EXTENSIONS)
    return F.lower(path).rlike(rf"\.(?:{ends})\z")


def language(path: Column) -> Column:
    """The language tag of a file path."""
    return F.when(is_js(path), F.lit("JS/TS")).otherwise(F.lit("Python"))


def _flags(code: Column, table: dict[str, list[str]]) -> Column:
    searches = constant_map({c: regex.searches(table[c]) for c in rules.CATEGORIES})
    return F.filter(
        constant(rules.CATEGORIES),
        lambda c: F.exists(F.try_element_at(searches, c), lambda r: regex.occurs(r, code, code)),
    )


def python_flags(code: Column) -> Column:
    """Categories whose Python patterns occur in the code, in category order."""
    return _flags(code, rules.PYTHON_BEHAVIOR)


def js_flags(code: Column) -> Column:
    """Categories whose JS/TS patterns occur in the code, in category order."""
    return _flags(code, rules.JS_BEHAVIOR)


def flags_by_language(code: Column, js: Column) -> Column:
    return F.when(js, js_flags(code)).otherwise(python_flags(code))


def either_flags(code: Column) -> Column:
    """Categories found by either rule set, whatever the language."""
    return _flags(code, {c: rules.PYTHON_BEHAVIOR[c] + rules.JS_BEHAVIOR[c] for c in rules.CATEGORIES})


def no_flags() -> Column:
    return constant([])


def unmentioned(flags: Column, description: Column) -> Column:
    """The flags none of whose words occur in the description."""
    words = constant_map(rules.MENTION_WORDS)

    def silent(lowered: Column) -> Column:
        return F.filter(flags, lambda c: ~F.exists(F.try_element_at(words, c), lambda w: F.contains(lowered, w)))

    return F.when(F.size(flags) > 0, let(F.lower(description), silent)).otherwise(no_flags())


def declared(description: Column) -> Column:
    """Capabilities a description declares, in category order (NULL declares none)."""
    words = constant_map(rules.DECLARE_WORDS)
    return let(
        F.lower(F.coalesce(description, F.lit(""))),
        lambda lowered: F.filter(
            constant(rules.CATEGORIES),
            lambda c: F.exists(F.try_element_at(words, c), lambda w: F.contains(lowered, w)),
        ),
    )


def lookup(key: Column, table: dict, default=None) -> Column:
    """A value from a small fixed table, held as one constant map."""
    found = F.try_element_at(constant_map(table), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def mismatch_severities(mismatches: Column) -> Column:
    """The distinct severities of the mismatching categories."""
    return F.array_distinct(
        F.transform(mismatches, lambda c: lookup(c, rules.MISMATCH_SEVERITY, "LOW"))
    )
