"""What a tool gets from its file, its name and its reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolguard.functions import capabilities as caps
from toolguard.functions.constants import let
from toolguard.scale import hot_keys, hottest, salted_join, unnest
from toolguard.sources.files import is_js_source, is_python_source, without_file_behavior
from toolguard.schemas import TOOL_KEY


def file_behavior(files: DataFrame) -> DataFrame:
    """Scanned files with at least one behavior flag (a map over files, no shuffle).

    Test files and pruned folders are left out, as in the scan for tools; two more folders are, for Python.
    """
    path = F.col("path")
    scanned = (is_python_source(path) & ~without_file_behavior(path)) | is_js_source(path)
    flags = caps.flags_by_language(F.col("content"), caps.is_js(F.col("path")))
    # Through an array of one, so that the size test does not compute the flags again.
    found = F.filter(F.array(flags), lambda f: F.size(f) > 0)
    return unnest(files.where(scanned), ["repo_id", "path"], found, "flags")


def attach_file_flags(tools: DataFrame, behavior: DataFrame) -> DataFrame:
    """Add ``file_flags``: the flags of a tool's file, for tools without a usable snippet.

    Only those tools are looked up; all others never enter the join.
    """
    usable = F.col("code_snippet").isNotNull() & (F.col("code_snippet") != "")
    flags = behavior.select("repo_id", F.col("path").alias("file"), F.col("flags").alias("file_flags"))
    looked_up = salted_join(tools.where(~usable), flags, ["repo_id", "file"], "left", spread=["seq"])
    return (
        tools.where(usable)
        .withColumn("file_flags", caps.no_flags())
        .unionByName(looked_up.withColumn("file_flags", F.coalesce("file_flags", caps.no_flags())))
    )


def behavior_flags(snippet: Column, file: Column, file_flags: Column) -> Column:
    """Flags of the snippet in the tool's own language; without one, those of the file."""
    usable = snippet.isNotNull() & (snippet != "")
    return (
        F.when(usable, caps.flags_by_language(snippet, caps.is_js(file)))
        .when(without_file_behavior(file), caps.no_flags())
        .otherwise(file_flags)
    )


def normalized_path(path: Column, root: str | None = None) -> Column:
    """A path without empty, ``.`` and ``..`` parts, relative to ``root`` if it lies below it.

    Other absolute paths keep their slash, and what climbs out of the repo keeps its ``..``.
    Most paths have none of that and stay as they are.
    """
    text = F.replace(path, F.lit("\\"), F.lit("/"))
    absolute = text.startswith("/")
    parts = F.aggregate(
        F.split(text, "/"),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part.isin("", "."), kept)
        .when(
            part == "..",
            F.when((F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) != ".."), F.slice(kept, 1, F.size(kept) - 1))
            .when(absolute, kept)
            .otherwise(F.concat(kept, F.array(part))),
        )
        .otherwise(F.concat(kept, F.array(part))),
    )
    written = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))
    # Rewriting resolves most relative paths, and quicker: parts without effect go, then two times a part with the ".." behind it.
    special = r"(?:^|/)\.{0,2}(?:/|\z)"
    quick = F.regexp_replace(F.regexp_replace(text, r"/(?:\.?/)+", "/"), r"^(?:\./)+", "")
    for _ in range(2):
        quick = F.regexp_replace(quick, r"(?<![^/])(?!\.{1,2}/)[^/]+/\.\./", "")
    resolved = let(quick, lambda q: F.when(absolute | q.rlike(special), written).otherwise(q))
    normal = F.when(path.rlike(special + r"|\\"), resolved).otherwise(path)
    if root is None:
        return normal
    base = "/" + "/".join(p for p in root.split("/") if p not in ("", ".")) + "/"
    return F.when(normal.startswith(base), F.substring(normal, F.lit(len(base) + 1), F.length(normal))).otherwise(normal)


def is_outside(file: Column) -> Column:
    """True for a normalized path that climbs out of its repo."""
    return (file == "..") | file.startswith("../")


def _keyed(findings: DataFrame, root: str | None) -> DataFrame:
    return findings.withColumn("file", normalized_path(F.col("path"), root))


def static_by_file(findings: DataFrame, root: str | None = None) -> DataFrame:
    """Static findings per file of the repo: how many, and how many weigh on the score."""
    # Counted per written path first: each spelling is normalized once, not once per finding.
    per_path = findings.groupBy("repo_id", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity").isin("ERROR", "WARNING")).alias("serious")
    )
    return (
        _keyed(per_path, root)
        .where(~is_outside(F.col("file")))
        .groupBy("repo_id", "file")
        .agg(F.sum("n").alias("static_findings"), F.sum("serious").alias("static_serious"))
    )


def static_outside(findings: DataFrame, root: str | None = None) -> DataFrame:
    """Per repo, the static findings on paths that climb out of it; they concern no file of it."""
    per_path = findings.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("n"))
    return _keyed(per_path, root).where(is_outside(F.col("file"))).groupBy("repo_id").agg(F.sum("n").alias("outside_findings"))


def static_in_tool_files(findings: DataFrame, tools: DataFrame, root: str | None = None) -> DataFrame:
    """The static findings on files that hold tools, one row each: line, message and severity."""
    held = tools.select("repo_id", normalized_path(F.col("file")).alias("file")).distinct()
    return (
        _keyed(findings, root)
        .join(held, ["repo_id", "file"], "left_semi")
        .select(
            "repo_id", "file", F.coalesce(F.col("line").cast("string"), F.lit("?")).alias("line"),
            F.coalesce("message", F.lit("No message")).alias("message"), F.coalesce("severity", F.lit("INFO")).alias("severity"),
        )
    )


def attach_static(tools: DataFrame, findings: DataFrame) -> DataFrame:
    """Add the counts of ``static_by_file``; the findings themselves stay keyed by file."""
    per_file = static_by_file(findings).withColumnRenamed("file", "__file")
    path = normalized_path(F.col("file"))
    keyed = tools.withColumn("__file", path)
    # Counted on the plain keys: what else the tools carry is not computed for it.
    hot = hot_keys(keyed.select("repo_id", "__file"), ["repo_id", "__file"])
    zero = F.lit(0).cast("bigint")
    return (
        salted_join(keyed, per_file, ["repo_id", "__file"], "left", spread=["seq"], hot=hot)
        .withColumns({c: F.coalesce(c, zero) for c in ("static_findings", "static_serious")})
        .drop("__file")
    )


def attach_shadowing(tools: DataFrame, by_name: DataFrame) -> DataFrame:
    """Add how many shadowing findings concern a tool's name."""
    keys = ["repo_id", "name"]
    counts = by_name.select(*keys, "registrations", "redirects", "shadowing_count")
    # A name that repeats is in `by_name`, with its count: no other key can be hot.
    hot = hottest(by_name.select(*keys, "registrations"), "registrations")
    zero = F.lit(0).cast("bigint")
    return (
        salted_join(tools, counts, keys, "left", spread=["file", "seq"], hot=hot)
        .withColumns(
            {
                "registrations": F.coalesce("registrations", zero + 1),
                "redirects": F.coalesce("redirects", zero),
                "shadowing_count": F.coalesce("shadowing_count", zero),
            }
        )
    )


def confirmed_mismatches(tools: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Remove every mismatch that a reviewer found covered by the description.

    A tool has one row of verdicts at most, with a category each.
    """
    covered = verdicts.where("covered").groupBy(*TOOL_KEY).agg(F.collect_set("category").alias("__covered"))
    kept = F.array_except("mismatches", F.coalesce("__covered", caps.no_flags()))
    return tools.join(covered, TOOL_KEY, "left").withColumn("mismatches", kept).drop("__covered")


def review_notes(tools: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every mismatch that was reviewed, with the reviewer's decision and reasoning."""
    each = unnest(tools, TOOL_KEY, F.col("mismatches"), "category")
    return each.join(verdicts.select(*TOOL_KEY, "category", "covered", "reasoning"), [*TOOL_KEY, "category"])
