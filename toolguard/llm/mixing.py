"""Mixing sources to target weights by repeating documents.

Sizes are summed by source, targets follow from weights and caps, and a source's
repetition rate is its target by its size. A document comes floor(rate) times plus
once more if a hash of its id, seeded, falls below the fraction. Each source draws with that
one of a few seeds whose words come nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolguard.llm.common import word_count
from toolguard.scale import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEEDS = 32
#: Partitions over which sources are ranked.
RANGES = 32


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (source, ...), one row each, with ``rank`` from 0: by code point, NULL last.

    Ranges are numbered on their own and shifted by the counts before them, so that
    no task sees all sources.
    """
    placed = materialize(
        sources.repartitionByRange(RANGES, F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id())
    )
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())) - 1
    # At most RANGES rows are broadcast.
    return placed.withColumn("rank", inside).join(F.broadcast(before), "__part").withColumn("rank", F.col("rank") + F.col("__before")).drop("__part", "__before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat along the ranked sources.

    All targets make up the sum of all sizes. A target above ``most`` times its source's size is
    cut to that, and the excess goes to the other sources by weight until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked(totals).withColumn("weight", weight).drop("rank"))
    cap = F.col("source_size") * F.lit(most)
    # A source is cut if weight * level exceeds its cap. The level only rises, so this
    # ends after a few rounds, each a sum over one row a source.
    level = 0.0
    while True:
        # The same addition in each round: a level changes only with the set of cut sources.
        cut = F.col("weight") * F.lit(level) > cap
        row = table.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(cut, cap)).alias("cut"), F.sum(F.when(~cut, F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        new = ((row["all"] or 0) - (row["cut"] or 0.0)) / row["open"]
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def copies(rate: Column, seed: Column, doc_id: Column) -> Column:
    """floor(rate) and one more if the seeded hash of the id is below the fraction."""
    whole = F.floor(rate)
    draw = F.shiftrightunsigned(F.xxhash64(seed, doc_id), 11) / F.lit(float(1 << 53))
    return whole + F.when(draw < rate - whole, 1).otherwise(0)


def rates(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """(source, source_size, target, rate, seed) from (doc_id, source, size)."""
    table = materialize(
        targets(sizes, weights, most).withColumn(
            "rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
        )
    )
    joined = with_rates(sizes, table)
    drawn = [F.sum(copies(F.col("rate"), F.lit(i), F.col("doc_id")) * F.col("size")).alias(f"s{i}") for i in range(seeds)]
    off = [F.struct(F.abs(F.col(f"s{i}") - F.col("target")).alias("off"), F.lit(i).alias("seed")) for i in range(seeds)]
    sums = joined.groupBy("source", "target").agg(*drawn)
    best = sums.select(F.col("source").alias("__source"), F.least(*off)["seed"].alias("seed") if seeds > 1 else F.lit(0).alias("seed"))
    return materialize(table.join(best, table["source"].eqNullSafe(best["__source"])).drop("__source"))


def with_rates(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source.

    One row a source, read from a written table, so Spark broadcasts it if its size allows; else
    a hot source is split by adaptive execution.
    """
    table = table.withColumnRenamed("source", "__source")
    return rows.join(table, rows["source"].eqNullSafe(table["__source"])).drop("__source")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source; others are ignored).

    ``taken`` is the number of words that the mix takes of the row, repeats counted. NULL and empty
    texts have size 0 and take nothing; NULL sources are one source, the last; NULL ids draw
    alike, and so do rows that repeat an id within a source. Reruns agree. An empty table gives no rows.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count("text").alias("size")))
    found = with_rates(sizes, rates(sizes, weights, most, seeds))
    taken = copies(F.col("rate"), F.col("seed"), F.col("doc_id")) * F.col("size")
    return found.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def emit(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, all columns, with ``copy`` from 1.

    Where ``docs`` has a column of that name, in any case, it stays, and the number's name gets underscores at its end.
    """
    name = "copy"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    sizes = materialize(docs.select("doc_id", "source", word_count("text").alias("size")))
    table = rates(sizes, weights, most, seeds).select("source", F.struct("rate", "seed").alias("__mix"))
    number = copies(F.col("__mix.rate"), F.col("__mix.seed"), F.col("doc_id")).cast("int")
    return (
        with_rates(docs, table)
        .withColumn(name, F.explode(F.when(number > 0, F.sequence(F.lit(1), number)).otherwise(F.array().cast("array<int>"))))
        .drop("__mix")
    )
