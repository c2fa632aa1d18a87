"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolguard.scale import materialize

#: A bound against endless loops only; components of n nodes take about log(n) rounds.
ROUNDS = 60


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every linked node with the smallest node that it reaches.

    Nodes are values that can be ordered; a NULL end is no link. Each round is
    written as a table, so a lost executor costs one round. Links of a hub
    are joined on the hub, a join that adaptive execution splits.
    """
    a, b = F.col(a), F.col(b)
    edges = materialize(
        links.where((a != b) & a.isNotNull() & b.isNotNull())
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = _signature(edges)
    for _ in range(ROUNDS):
        if before[0] == 0:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        edges = materialize(small)
        now = _signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    # Decimal sums of hashes: they don't overflow.
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]
