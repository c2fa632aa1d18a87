"""Helpers that keep jobs whole and even when the data is large and uneven."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The largest keys are salted: at most HOT_KEYS of them, a list that is safe to
# broadcast whatever the data.  A key that is not among them holds less than
# 1/HOT_KEYS of all rows, and joins like any other.
HOT_KEYS = 10_000
HOT_FLOOR = 1_000_000
SALTS = 64
# Rows that a task of a join makes, about.
MADE = 16_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session that
    names none gets a temporary folder; on a cluster that would not be shared.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="toolguard-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute once what several branches read: a table written to the shared folder.

    It cuts the lineage like a checkpoint, survives lost executors, and each
    branch reads just the columns that it needs, which a checkpoint cannot do.
    """
    path = scratch(df.sparkSession, "tables")
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, before the program ends; nothing may read them any more."""
    for made in tables:
        _remove(made.sparkSession, made.scratch_path)


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of what is written inside go with it; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when this program ends."""
    path = f"{checkpoint_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: a session that was stopped before leaves its folders."""
    with contextlib.suppress(Exception):
        context = spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def hot_keys(df: DataFrame, on: list[str], floor: int | None = None) -> DataFrame:
    """The largest keys of ``df``, from combinable counts."""
    return hottest(df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows")), "__rows", floor)


def hottest(counts: DataFrame, rows: str, floor: int | None = None) -> DataFrame:
    """The largest keys of a table of counts; all other keys stay out of it."""
    floor = HOT_FLOOR if floor is None else floor
    return counts.where(F.col(rows) > floor).orderBy(F.desc(rows)).limit(HOT_KEYS)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    hot: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi join whose hot left keys are spread over ``salts`` partitions each.

    Only rows of hot keys are salted, by the ``spread`` columns, and only the
    right rows of hot keys are repeated, ``salts`` times.  All other keys join
    as they would without it.
    """
    if hot is None:
        hot = hot_keys(left, on)
    flagged = F.broadcast(hot.select(*on).withColumn("__hot", F.lit(True)))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_left = left.join(flagged, on, "left").withColumn(
        "__salt",
        F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0),
    )
    salted_right = right.join(flagged, on, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0))))
    )
    return salted_left.drop("__hot").join(salted_right.drop("__hot"), [*on, "__salt"], how).drop("__salt")


def expanding_join(left: DataFrame, right: DataFrame, on: list[str], sizes: DataFrame, spread: list[str], made: int = MADE) -> DataFrame:
    """Inner equi join that makes many more rows than its sides hold, even over the tasks.

    ``sizes`` (on, made) has the rows that each key makes. A key that makes more than ``made`` is cut into a grid:
    its left rows are dealt by the ``spread`` columns and its right rows by all of theirs, and each part of one side
    meets each part of the other. Were only one side cut, the other would be repeated for every piece; so both
    are repeated about as much, and what is shuffled grows as the root of the pieces. The number of
    partitions follows the result too: adaptive execution, which goes by the sides' bytes, leaves it alone.
    """
    total = sizes.agg(F.sum("made")).first()[0] or 0
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(2 * total // made))
    hot = materialize(hottest(sizes, "made", made).select(*on, F.col("made").alias("__made"), F.ceil(F.col("made") / made).alias("__pieces")))
    counted = right.join(F.broadcast(hot), on).groupBy(*on, "__made", "__pieces").agg(F.count(F.lit(1)).alias("__n"))
    columns = F.least(F.round(F.sqrt(F.col("__pieces") / F.col("__made")) * F.col("__n")).cast("long"), "__pieces")
    grid = counted.withColumn("__columns", F.greatest(F.lit(1), columns))
    grid = F.broadcast(materialize(grid.select(*on, "__columns", F.ceil(F.col("__pieces") / F.col("__columns")).alias("__lines"))))

    def dealt(side: DataFrame, by: list[str], own: str, other: str) -> DataFrame:
        number = lambda c: F.coalesce(f"{c}s", F.lit(1))
        every = F.explode(F.sequence(F.lit(0).cast("long"), number(other) - 1))
        placed = side.join(grid, on, "left").withColumn(own, F.pmod(F.xxhash64(*by), number(own))).withColumn(other, every)
        return placed.drop("__lines", "__columns").repartition(parts, *on, "__line", "__column")

    met = dealt(left, spread, "__line", "__column").join(dealt(right, [c for c in right.columns if c not in on], "__column", "__line"), [*on, "__line", "__column"])
    return met.drop("__line", "__column")


def first_per_group(
    df: DataFrame, keys: list[str], order: list[str], n: int, salts: int = SALTS
) -> DataFrame:
    """The first ``n`` rows of each group, exactly, without one task seeing a whole group.

    Rows are ranked inside salted parts of a group first; at most
    ``n * salts`` rows of a group reach the second ranking.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(salts))
    inner = Window.partitionBy(*keys, "__part").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__part", part)
        .withColumn("__rank", F.row_number().over(inner))
        .where(F.col("__rank") <= n)
        .withColumn("__rank", F.row_number().over(outer))
        .where(F.col("__rank") <= n)
        .drop("__part", "__rank")
    )


def unnest(df: DataFrame, keep: list[str], array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element.

    A plain ``explode`` makes the optimizer test the array's size in a filter of
    its own, which computes the array twice; the outer form does not.
    """
    made = F.explode_outer(array).alias(name) if position is None else F.posexplode_outer(array).alias(position, name)
    return df.select(*keep, made).where(F.col(name).isNotNull())


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def one_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
