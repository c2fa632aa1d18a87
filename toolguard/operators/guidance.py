"""What findings could lead to, and how to prevent it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolguard.functions.capabilities import lookup
from toolguard.guidance import GUIDANCE


def _table(kind: str, part: int) -> dict:
    return {key: texts[part] for (k, key), texts in GUIDANCE.items() if k == kind}


def capability_guidance(category: Column) -> Column:
    return F.struct(
        category.alias("category"),
        lookup(category, _table("capability", 0)).alias("impact"),
        lookup(category, _table("capability", 1)).alias("prevention"),
    )


def risk_prevention(risk_level: Column) -> Column:
    return lookup(risk_level, _table("risk", 1), "")


def finding_guidance(kind: str) -> Column:
    impact, prevention = GUIDANCE[("finding", kind)]
    return F.struct(F.lit(impact).alias("impact"), F.lit(prevention).alias("prevention"))


def finding_guidance_by(kind: Column) -> Column:
    """Guidance for a column of finding kinds."""
    return F.struct(
        lookup(kind, _table("finding", 0)).alias("impact"), lookup(kind, _table("finding", 1)).alias("prevention")
    )
