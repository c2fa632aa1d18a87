"""Constant tables as single literals.

A rule table becomes one SQL literal (an array, map or struct of constants), so a
plan holds one folded constant for it instead of hundreds of column objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql(value) -> str:
    """SQL text of a constant: lists are arrays, dicts with text keys are structs."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"{sql(k)}, {sql(v)}" for k, v in value.items()) + ")"
    return "array(" + ", ".join(sql(v) for v in value) + ")" if value else "CAST(array() AS ARRAY<STRING>)"


def constant(value) -> Column:
    return F.expr(sql(value))


def constant_map(table: dict) -> Column:
    """A map from the keys of a table to its values."""
    return F.expr("map(" + ", ".join(f"{sql(k)}, {sql(v)}" for k, v in table.items()) + ")")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
