"""Files to tools, where the files lie: one pass, without a shuffle."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from toolguard import functions, rules
from toolguard.functions import capabilities as caps
from toolguard.functions import regex
from toolguard.functions.parsing import parse_batches
from toolguard.scale import materialize, salted_join, unnest
from toolguard.sources import trees
from toolguard.sources.files import decoded

TOOL = StructType([StructField("seq", LongType()), *(StructField(n, StringType()) for n in ("name", "description", "code_snippet"))])
# A Python file can only yield a tool if one of these words occurs in it.
# Identifiers may also be spelled in compatibility characters, hence non-ASCII.
PYTHON_HINT = r"[Tt]ool|app|router|[^\x00-\x7f]"


def can_hold_tools(language: Column, content: Column) -> Column:
    """A test that never drops a file that holds a tool."""
    js = regex.contains_any(content, list(rules.JS_MARKS))
    return F.when(language == "JS/TS", js).otherwise(content.rlike(PYTHON_HINT))


def with_tools(files: DataFrame) -> DataFrame:
    """``files`` (language, ..., content) with ``tools`` in the place of ``content``, their last column.

    Each file is parsed where it lies.  Moving texts together would save parsing copies that
    different tasks hold, at the price of shuffling all source text; copies
    within a task are parsed once.  The parsing helpers travel with the job.
    """
    schema = StructType([*(f for f in files.schema if f.name != "content"), StructField("tools", ArrayType(TOOL))])
    cloudpickle.register_pickle_by_value(functions)
    try:
        return files.mapInArrow(parse_batches, schema)
    finally:
        cloudpickle.unregister_pickle_by_value(functions)


def extract_tools(sources: DataFrame) -> DataFrame:
    """Tools of every file, with the behavior flags of the file as ``file_flags``."""
    content, language = F.col("content"), F.col("language")
    flags = caps.flags_by_language(content, language == "JS/TS")
    chosen = sources.where(can_hold_tools(language, content))
    parsed = with_tools(chosen.select("repo_id", F.col("path").alias("file"), "language", flags.alias("file_flags"), "content"))
    return tool_rows(parsed)


def extract_once(files: DataFrame, root: str) -> DataFrame:
    """Tools of every file of a tree, each distinct content parsed once in the whole corpus.

    ``files`` (repo_id, path, language, tree_path, size) names files below ``root`` (``trees.list_repos``). Files are
    digested where they lie; only digests and places are shuffled, one place a digest is chosen, and only
    the chosen files are loaded, flagged and parsed. Their tools then meet all places of the digest, popular ones
    salted. The same rows as of ``extract_tools``.
    """
    places = materialize(trees.with_digests(trees.spread(files), root))
    distinct = places.groupBy("digest", "language").agg(F.min(F.struct("tree_path", "size")).alias("p"))
    chosen = trees.spread(materialize(distinct.select("digest", "language", "p.tree_path", "p.size")))
    text = decoded(F.col("bytes"))
    held = trees.with_contents(chosen, root).select("digest", "language", text.alias("content"))
    flags = caps.flags_by_language(F.col("content"), F.col("language") == "JS/TS")
    prepared = held.where(can_hold_tools(F.col("language"), F.col("content"))).select("digest", "language", flags.alias("file_flags"), "content")
    parsed = materialize(with_tools(prepared).where(F.size("tools") > 0))
    at = salted_join(places.select("repo_id", F.col("path").alias("file"), "digest", "language"), parsed, ["digest", "language"], "inner", spread=["file", "repo_id"])
    return tool_rows(at)


def tool_rows(parsed: DataFrame) -> DataFrame:
    """One row per tool of files with ``tools``."""
    return unnest(parsed, ["repo_id", "file", "language", "file_flags"], F.col("tools"), "t").select(
        "repo_id", "file", "language", "t.seq", "t.name", "t.description", "t.code_snippet", "file_flags"
    )
