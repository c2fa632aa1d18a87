"""Source files: reading, choosing and budgeting them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import capabilities as caps
from toolguard.functions.constants import constant
from toolguard.scale import first_per_group

EXTENSIONS = "*.{py,js,ts,mjs,cjs,jsx,tsx,txt}"


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes without the bad ones, with ``\\n`` as the only line end."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def read_source_files(spark: SparkSession, root: str, pattern: str = EXTENSIONS) -> DataFrame:
    """Every file below ``root/<repo_id>/``, one row per file."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "content")
    )
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", rf"^.*?\Q{base}\E/", "")
    return raw.select(
        F.substring_index(relative, "/", 1).alias("repo_id"),
        F.regexp_replace(relative, "^[^/]*/", "").alias("path"),
        decoded(F.col("content")).alias("content"),
    )


def _parts(path: Column) -> Column:
    return F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")


def _has_part(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts, constant(names))


def _ends(text: Column, suffixes: tuple[str, ...]) -> Column:
    return text.rlike(f"(?:{'|'.join(re.escape(s) for s in suffixes)})\\z")


def _folders(path: Column) -> Column:
    parts = _parts(path)
    return F.slice(parts, 1, F.size(parts) - 1)


def is_python_test(path: Column) -> Column:
    """Test folders, ``test_*``, ``*_test.py`` and ``conftest.py``."""
    parts = _parts(path)
    name = F.element_at(parts, -1)
    return (
        _has_part(parts, rules.PYTHON_TEST_DIRS)
        | name.startswith("test_")
        | name.endswith("_test.py")
        | (name == "conftest.py")
    )


def is_js_skipped(path: Column) -> Column:
    """Test and build folders, test and type declaration files."""
    parts = _parts(path)
    name = F.element_at(parts, -1)
    return _has_part(parts, rules.JS_SKIPPED_DIRS) | _ends(name, rules.JS_SKIPPED_SUFFIXES)


def is_python_source(path: Column) -> Column:
    pruned = _has_part(_folders(path), rules.PYTHON_PRUNED_DIRS)
    return path.endswith(".py") & ~pruned & ~is_python_test(path)


def is_js_source(path: Column) -> Column:
    return _ends(path, rules.JS_EXTENSIONS) & ~_has_part(_folders(path), rules.JS_PRUNED_DIRS) & ~is_js_skipped(path)


def without_file_behavior(path: Column) -> Column:
    """Python files in folders that only the file-level behavior scan leaves out."""
    return path.endswith(".py") & _has_part(_folders(path), rules.PYTHON_BEHAVIOR_PRUNED_DIRS)


def tool_sources(files: DataFrame) -> DataFrame:
    """The Python and JS/TS files to look for tools in, with their language."""
    chosen = is_python_source(F.col("path")) | is_js_source(F.col("path"))
    return files.where(chosen).withColumn("language", caps.language(F.col("path")))


def language_counts(sources: DataFrame) -> DataFrame:
    """Files per repo and language."""
    return sources.groupBy("repo_id").agg(
        F.count_if(F.col("language") == "Python").alias("python_files"),
        F.count_if(F.col("language") == "JS/TS").alias("js_files"),
    )


def budget_warnings(counts: DataFrame, limit: int, analysis: int) -> DataFrame:
    """What limits that a caller applies leave out: files per language beyond ``limit``, analysis beyond ``analysis`` files."""
    return (
        counts.withColumn("capped", (F.col("python_files") > limit) | (F.col("js_files") > limit))
        .withColumn("too_large", F.col("python_files") + F.col("js_files") > analysis)
        .withColumn(
            "warning",
            F.when(
                F.col("capped"),
                f"This repo has more than {limit} files in one language - only the first {limit} of that language "
                "were scanned for tools, and static analysis was skipped entirely.",
            ).when(
                F.col("too_large"),
                f"This repo has more than {analysis} Python + JS/TS files combined, so static analysis was skipped "
                f"(tools were still scanned across up to {limit} files per language).",
            ),
        )
    )


def within_budget(sources: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` files of a repo and language by path, for a caller that asks for it.

    Only keys are ranked; file contents meet the last allowed path of their repo, if it has one.
    """
    keys = sources.select("repo_id", "language", "path")
    last = (
        first_per_group(keys, ["repo_id", "language"], ["path"], limit)
        .groupBy("repo_id", "language")
        .agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("last_path"))
        .where(F.col("n") >= limit)
        .drop("n")
    )
    return (
        sources.join(last, ["repo_id", "language"], "left")
        .where(F.col("last_path").isNull() | (F.col("path") <= F.col("last_path")))
        .drop("last_path")
    )
