"""Every query by name: ``(spark, folder) -> DataFrame`` with flat, typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import arguments as args
from toolguard.functions import capabilities as caps
from toolguard.functions import risk
from toolguard.operators import (
    attach, blast, extraction, gate, guidance, history, injection, packages, permissions, policy, report,
    secrets, shadowing, urls,
)
from toolguard.plans import scan
from toolguard.queries import views
from toolguard.scale import materialize, scratch, unnest
from toolguard.sources import files, requirements, tables
from toolguard.streaming import calls as call_streams
from toolguard.streaming import scans as scan_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def listed(array: Column) -> Column:
    return F.array_join(array, ",")


# ---------------------------------------------------------------------- calls
CUSTOM_RULES = [
    {"name": "Allow uploads", "match": {"tool_name": "^upload$"}, "action": "ALLOW", "reason": "trusted", "severity": "odd"},
    {
        "name": "Any token or page call", "match_type": "any", "action": "LOG", "severity": "LOW",
        "match": {"arguments_not_empty": ["token"], "tool_name_contains": "VIEW", "description_contains": "report"},
    },
    {"name": "Scripts that count", "match": {"arguments_not_empty": ["script", "count"]}, "action": "BLOCK"},
    {"name": "Scripts with lists", "match": {"arguments_not_empty": ["script", "list"], "arg_matches": {"list": r"\[1, \d+\]"}}, "action": "BLOCK"},
    {"name": "Null search", "match": {"arg_matches": {"q": "^none$", "z": "^1"}}, "action": "REQUIRE_APPROVAL", "reason": "no text", "severity": "MEDIUM"},
]


def custom_policy() -> dict:
    """Own rules first, one default rule removed, one rule added at the end."""
    base = policy.default_policy()
    own = {**base, "default_action": "LOG", "rules": [*CUSTOM_RULES, *base["rules"]]}
    own = policy.remove_rule(own, "Require approval for subprocess execution")
    return policy.add_rule(own, policy.named_rule("No scripts", "BLOCK", tool_name="run_script"))


@query
def policy_decisions(spark, folder):
    decided = policy.decide(views.calls(spark, folder), policy.default_policy())
    return decided.select(
        "event_id", "call_ts", "tool_name", "call_id", "action", "rule", "reason", "severity", "logged_arguments"
    )


@query
def policy_totals(spark, folder):
    return policy.totals(policy.decide(views.calls(spark, folder), policy.default_policy()))


@query
def policy_custom_rules(spark, folder):
    decided = policy.decide(views.calls(spark, folder), custom_policy())
    return decided.select("event_id", "action", "rule", "reason", "severity")


# Patterns with inline flags, each a rule on an argument of two lines.
FLAGGED_PATTERNS = [r"(?s)^c.*7\n*$", r"(?m)^view$", r"^purchase\n\d*[02468]$", r"(?m:^)1\d*$(?#end)", r"^s.*9$", r"(?:^|x)(?s:search.)5"]


@query
def policy_patterns(spark, folder):
    tested = [{"name": p, "match": {"arg_matches": {"q": p}}, "action": "BLOCK"} for p in FLAGGED_PATTERNS]
    two_lines = F.to_json(F.struct(F.concat("event_type", F.lit("\n"), F.col("user_id").cast("string")).alias("q")))
    events = views.spread(spark, folder, "events", "event_id", "event_type", "user_id")
    calls = events.select(
        "event_id", F.lit("t").alias("tool_name"), two_lines.alias("arguments"), F.lit(None).cast("string").alias("description"),
        F.array().cast("array<string>").alias("capabilities"),
    )
    return policy.decide(calls, {"rules": tested}).select("event_id", "action", "rule")


@query
def unreadable_calls(spark, folder):
    calls = views.calls(spark, folder)
    # Every fourth call is cut off, every fourth holds a list.
    broken = F.when(F.col("event_id") % 4 == 1, F.expr("left(arguments, length(arguments) - 1)")).when(
        F.col("event_id") % 4 == 2, F.concat(F.lit("["), "arguments", F.lit("]"))
    )
    calls = calls.withColumn("arguments", F.coalesce(broken, "arguments"))
    decided = policy.decide(calls, policy.default_policy()).where("arguments_unreadable")
    return decided.select("event_id", "tool_name", "action", "rule", "reason", "severity", "logged_arguments")


@query
def policy_default_trail(spark, folder):
    return policy.default_decisions(policy.decide(views.calls(spark, folder), policy.default_policy()))


@query
def call_ids(spark, folder):
    calls = views.calls(spark, folder).withColumn("entries", args.entries(args.parsed(F.col("arguments"))))
    name = F.coalesce("tool_name", F.lit("unknown"))
    written = calls.withColumn("canonical_arguments", args.canonical(F.col("entries")))
    return written.select("event_id", "canonical_arguments", args.call_id(name, F.col("canonical_arguments")).alias("call_id"))


# --------------------------------------------------------------- descriptions
@query
def risk_levels(spark, folder):
    text = risk.searchable(F.col("name"), F.col("description"))
    return (
        views.tools(spark, folder)
        .withColumn("text", text)
        .withColumn("risk_level", risk.level(F.col("text")))
        .select(
            "repo_id", "file", "seq", "risk_level",
            risk.keyword(F.col("text"), F.col("risk_level")).alias("risk_keyword"),
            risk.explanation(F.col("risk_level")).alias("risk_explanation"),
        )
    )


@query
def injection_findings(spark, folder):
    return injection.injection_findings(views.tools(spark, folder))


@query
def redirect_findings(spark, folder):
    return shadowing.redirect_findings(views.tools(spark, folder))


@query
def duplicate_names(spark, folder):
    return shadowing.duplicate_names(views.tools(spark, folder))


@query
def duplicate_files(spark, folder):
    return shadowing.duplicate_files(views.tools(spark, folder))


@query
def shadowing_findings(spark, folder):
    return shadowing.shadowing_findings(views.tools(spark, folder))


@query
def shadowing_by_name(spark, folder):
    return shadowing.shadowing_by_name(views.tools(spark, folder))


# --------------------------------------------------------------- capabilities
def tools_with_flags(spark, folder) -> DataFrame:
    return attach.attach_file_flags(views.tools(spark, folder), views.file_flags(spark, folder))


@query
def snippet_flags(spark, folder):
    code = F.coalesce("code_snippet", F.lit(""))
    return views.tools(spark, folder).select(
        "repo_id", "file", "seq",
        listed(caps.python_flags(code)).alias("python_flags"),
        listed(caps.js_flags(code)).alias("js_flags"),
        listed(caps.either_flags(code)).alias("either_flags"),
    )


@query
def file_behavior(spark, folder):
    return attach.file_behavior(views.source_files(spark, folder)).select(
        "repo_id", "path", listed(F.col("flags")).alias("flags")
    )


@query
def tool_behavior(spark, folder):
    return report.with_behavior(tools_with_flags(spark, folder)).select(
        "repo_id", "file", "seq", "language",
        listed(F.col("actual_behavior")).alias("actual_behavior"),
        listed(F.col("mismatches")).alias("mismatches"),
        listed(F.array_sort(caps.mismatch_severities(F.col("mismatches")))).alias("mismatch_severities"),
    )


@query
def declared_capabilities(spark, folder):
    return views.tools(spark, folder).select(
        "repo_id", "file", "seq", listed(caps.declared(F.col("description"))).alias("declared")
    )


def _matrix(prefix: str) -> list[Column]:
    lists = ["declared", "actual", "undisclosed_actual", "extra_declared", "excessive"]
    plain = ["permission_count", "has_undisclosed", "has_extra_declared"]
    return [*(listed(F.col(f"{prefix}.{n}")).alias(n) for n in lists), *(F.col(f"{prefix}.{n}") for n in plain)]


@query
def permission_matrix(spark, folder):
    analyzed = permissions.analyze(tools_with_flags(spark, folder))
    return analyzed.select("repo_id", "file", "seq", *_matrix("permission_matrix"), "permission_severity")


@query
def permission_findings(spark, folder):
    return permissions.permission_findings(permissions.analyze(tools_with_flags(spark, folder)))


def _last(spark, folder) -> DataFrame:
    return permissions.last_by_name(permissions.analyze(tools_with_flags(spark, folder)))


@query
def last_analysis_by_name(spark, folder):
    return _last(spark, folder).select(
        "repo_id", "name", "severity", listed(F.col("actual")).alias("actual"), listed(F.col("declared")).alias("declared")
    )


# --------------------------------------------------------------- blast radius
def _radius(spark, folder) -> DataFrame:
    text = risk.searchable(F.col("name"), F.col("description"))
    behaving = report.with_behavior(tools_with_flags(spark, folder)).withColumn("text", text)
    leveled = behaving.withColumn("risk_level", risk.level(F.col("text")))
    return leveled.withColumn("b", blast.blast_radius(F.col("text"), F.col("actual_behavior"), F.col("risk_level")))


@query
def blast_radius(spark, folder):
    return _radius(spark, folder).select("repo_id", "file", "seq", "b.score", "b.label", "b.components.*")


@query
def attack_paths(spark, folder):
    paths = unnest(_radius(spark, folder), ["repo_id", "file", "seq"], F.col("b.attack_paths"), "p", "ord")
    return paths.select(
        "repo_id", "file", "seq", "ord", F.col("p.name").alias("path"), "p.description",
        listed(F.col("p.reaches")).alias("reaches"), listed(F.col("p.requires")).alias("requires"),
    )


@query
def blast_by_name(spark, folder):
    return blast.by_name(_last(spark, folder)).select("repo_id", "name", "score", "label", "components.*")


@query
def repo_blast_summary(spark, folder):
    return blast.repo_summaries(views.repos(spark, folder), blast.by_name(_last(spark, folder)))


@query
def blast_ranking(spark, folder):
    return blast.ranked(materialize(blast.by_name(_last(spark, folder))))


# --------------------------------------------------------- packages and secrets
def _pins(spark, folder) -> DataFrame:
    return requirements.parse_requirements(views.requirement_files(spark, folder))


def _pins_once(spark, folder) -> DataFrame:
    # For queries that read them more than once.
    return materialize(_pins(spark, folder))


@query
def pinned_requirements(spark, folder):
    return _pins(spark, folder)


@query
def first_requirements(spark, folder):
    return requirements.parse_requirements(views.requirement_files(spark, folder), first=2)


@query
def typosquats(spark, folder):
    return packages.typosquats(_pins(spark, folder))


def _vulnerable(spark, folder, pins: DataFrame, *tell: str) -> DataFrame:
    return packages.vulnerabilities(pins, views.advisories(spark, folder), tell=tell)


def _weaknesses(spark, folder, pins: DataFrame) -> DataFrame:
    # For queries that count vulnerable packages or look for the worst severity.
    return packages.weaknesses(pins, views.advisories(spark, folder))


@query
def vulnerable_packages(spark, folder):
    return _vulnerable(spark, folder, _pins_once(spark, folder), "vuln_id", "summary", "severity")  # as its SQL has it


@query
def dependency_summary(spark, folder):
    pins = _pins_once(spark, folder)
    return packages.dependency_summary(
        views.repos(spark, folder), pins, _weaknesses(spark, folder, pins), views.requirement_files(spark, folder)
    )


@query
def secrets_in_documents(spark, folder):
    return secrets.scan(views.spread(spark, folder, "documents", "doc_id", "text"), "text", ["doc_id"])


@query
def secrets_in_pages(spark, folder):
    return secrets.scan(views.pages(spark, folder), "html", ["page_id"])


@query
def secrets_in_files(spark, folder):
    return secrets.scan_files(views.source_files(spark, folder))


# -------------------------------------------------------------- URLs and scores
@query
def repository_urls(spark, folder):
    normal = urls.normalized(F.col("url"))
    return views.urls(spark, folder).select(
        "page_id", normal.alias("normalized"), urls.is_valid(normal).alias("valid"), urls.repo_key(F.col("url")).alias("repo_key")
    )


@query
def latest_scores(spark, folder):
    return history.latest(history.with_key(views.scans(spark, folder)))


@query
def score_lookup(spark, folder):
    wanted = views.table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("github.com/org/repo"), F.col("c_custkey").cast("string")).alias("url")
    )
    found = history.lookup(history.with_key(views.scans(spark, folder)), wanted)
    return found.select("c_custkey", "repo_key", "score", "scanned_at")


@query
def badges(spark, folder):
    latest = history.latest(history.with_key(views.scans(spark, folder)))
    return latest.select("repo_key", "score", urls.badge(F.col("score"), F.lit("tool security")).alias("b")).select(
        "repo_key", "score", "b.*"
    )


# ------------------------------------------------------------------ the report
@query
def static_findings_by_file(spark, folder):
    return attach.static_by_file(views.static_findings(spark, folder))


@query
def static_findings_by_tool_file(spark, folder):
    return attach.static_in_tool_files(views.static_findings(spark, folder), views.tools(spark, folder))


def _report(spark, folder, reviewed: bool = False) -> DataFrame:
    verdicts = views.verdicts(spark, folder) if reviewed else None
    # Read by several branches of the report: computed once.
    return report.tool_report(materialize(tools_with_flags(spark, folder)), views.static_findings(spark, folder), verdicts)


@query
def tool_report(spark, folder):
    return _report(spark, folder).select(
        "repo_id", "file", "seq", "name", "language", "description",
        listed(F.col("actual_behavior")).alias("actual_behavior"),
        listed(F.col("mismatches")).alias("mismatches"),
        "static_findings", "static_serious", "risk_level", "risk_keyword",
        F.size("injection_findings").alias("injections"),
        "registrations", "redirects", "shadowing_count", "permission_severity",
        F.col("blast_radius.score").alias("blast_score"), F.col("blast_radius.label").alias("blast_label"),
        "score",
    )


@query
def reviewed_mismatches(spark, folder):
    return _report(spark, folder, reviewed=True).select(
        "repo_id", "file", "seq", listed(F.col("mismatches")).alias("mismatches"), "score"
    )


@query
def review_notes(spark, folder):
    return attach.review_notes(report.with_behavior(tools_with_flags(spark, folder)), views.verdicts(spark, folder))


@query
def finding_guidance(spark, folder):
    found = report.with_behavior(tools_with_flags(spark, folder))
    text = risk.searchable(F.col("name"), F.col("description"))
    explained = F.transform("mismatches", guidance.capability_guidance)
    by_category = unnest(found, ["repo_id", "file", "seq"], explained, "g").select(
        "repo_id", "file", "seq", F.col("g.category").alias("about"), "g.impact", "g.prevention"
    )
    level = risk.level(text)
    by_risk = found.select(
        "repo_id", "file", "seq", level.alias("about"), F.lit(None).cast("string").alias("impact"),
        guidance.risk_prevention(level).alias("prevention"),
    )
    kinds = F.array_compact(
        F.array(
            F.when(F.size(injection.findings(F.col("description"))) > 0, "injection"),
            F.when(shadowing.redirect(F.col("description")).isNotNull(), "shadowing"),
        )
    )
    by_kind = (
        unnest(found, ["repo_id", "file", "seq"], kinds, "about")
        .withColumn("g", guidance.finding_guidance_by(F.col("about")))
        .select("repo_id", "file", "seq", "about", "g.impact", "g.prevention")
    )
    return by_category.unionByName(by_risk).unionByName(by_kind)


@query
def scan_counts(spark, folder):
    return report.scan_counts(_report(spark, folder))


def _found(spark, folder, levels: dict) -> DataFrame:
    return gate.findings_per_repo(views.repos(spark, folder), *gated(spark, folder), levels)


def gated(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What gates look at: the report, secrets, vulnerable and look-alike packages."""
    pins = _pins_once(spark, folder)
    leaked = secrets.scan_files(views.source_files(spark, folder))
    return _report(spark, folder), leaked, _weaknesses(spark, folder, pins), packages.typosquats(pins)


@query
def gate_failures(spark, folder):
    return gate.failures(*gated(spark, folder), rules.PRESETS["default"])


@query
def repo_guidance(spark, folder):
    """Guidance for what concerns a repo rather than a tool."""
    pins = _pins_once(spark, folder)
    leaked = secrets.scan_files(views.source_files(spark, folder)).select("repo_id", F.lit("secret").alias("about"), F.col("file").alias("item"))
    # Rows are made narrow and get their texts in a step of their own, which coalesce parts from the join: a join copies each
    # row that it makes. No table has as many partitions, so they stay as they are.
    weak = _vulnerable(spark, folder, pins, "vuln_id").select("repo_id", F.col("vuln_id").alias("item")).coalesce(1 << 24)
    weak = weak.select("repo_id", F.lit("dependency").alias("about"), "item")
    alike = packages.typosquats(pins).select("repo_id", F.lit("typosquat").alias("about"), F.col("package").alias("item"))
    found = leaked.unionByName(weak).unionByName(alike).withColumn("g", guidance.finding_guidance_by(F.col("about")))
    return found.select("repo_id", "about", "item", "g.impact", "g.prevention")


@query
def overall_scores(spark, folder):
    return _found(spark, folder, rules.PRESETS["default"])


@query
def gate_default(spark, folder):
    levels = rules.PRESETS["default"]
    return gate.evaluate(_found(spark, folder, levels), levels)


@query
def gate_strict(spark, folder):
    levels = rules.PRESETS["strict"]
    return gate.evaluate(_found(spark, folder, levels), levels)


@query
def gate_lenient(spark, folder):
    levels = rules.PRESETS["lenient"]
    return gate.evaluate(_found(spark, folder, levels), levels)


@query
def build_decisions(spark, folder):
    levels = {**rules.PRESETS["lenient"], "overall": "YELLOW"}
    return gate.decisions(gate.evaluate(_found(spark, folder, levels), levels), "YELLOW")


# ----------------------------------------------------------------- source files
@query
def tool_source_files(spark, folder):
    return files.tool_sources(views.source_files(spark, folder)).select("repo_id", "path", "language")


@query
def language_counts(spark, folder):
    return files.language_counts(files.tool_sources(views.source_files(spark, folder)))


@query
def budget_warnings(spark, folder):
    counts = files.language_counts(files.tool_sources(views.source_files(spark, folder)))
    return files.budget_warnings(counts, limit=7, analysis=9)


@query
def files_within_budget(spark, folder):
    chosen = files.tool_sources(views.source_files(spark, folder))
    return files.within_budget(chosen, limit=7).select("repo_id", "path", "language")


def _extracted(spark, folder) -> DataFrame:
    return extraction.extract_tools(files.tool_sources(views.source_files(spark, folder)))


@query
def extracted_tools(spark, folder):
    return _extracted(spark, folder).withColumn("file_flags", listed(F.col("file_flags")))


def _corpus(spark, folder) -> scan.Scan:
    code = views.source_files(spark, folder)
    return scan.scan_corpus(
        code.unionByName(views.requirement_files(spark, folder)), views.advisories(spark, folder),
        views.static_findings(spark, folder),
    )


@query
def corpus_report(spark, folder):
    return _corpus(spark, folder).report.select(
        "repo_id", "file", "seq", "name", "language", listed(F.col("actual_behavior")).alias("actual_behavior"),
        listed(F.col("mismatches")).alias("mismatches"), "risk_level",
        listed(F.col("permission_matrix.actual")).alias("actual"), "permission_severity",
        "shadowing_count", F.col("blast_radius.score").alias("blast_score"), "score",
    )


@query
def corpus_builds(spark, folder):
    return _corpus(spark, folder).builds(rules.PRESETS["default"], "RED")


# ----------------------------------------------------- through files and back
@query
def calls_read_back(spark, folder):
    """Calls written as JSON, read as a call file and decided."""
    path = scratch(spark, "calls")
    views.calls(spark, folder).drop("event_id").write.json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    decided = policy.decide(tables.read_calls(spark, path, multiline=False), policy.default_policy())
    return decided.select("tool_name", "call_id", "action", "rule", "logged_arguments")


@query
def policy_read_back(spark, folder):
    """The custom policy written as JSON, read again and applied."""
    path = scratch(spark, "policy")
    spark.createDataFrame([(tables.policy_json(custom_policy()),)], "value string").coalesce(1).write.text(path)
    decided = policy.decide(views.calls(spark, folder), tables.read_policy(spark, path))
    return decided.select("event_id", "action", "rule", "reason", "severity")


@query
def report_read_back(spark, folder):
    path = scratch(spark, "report")
    tables.write_report(_report(spark, folder), path, "json", buckets=8)
    return spark.read.schema("repo_id string, file string, seq bigint, risk_level string, score string").json(path).select(
        "repo_id", "file", "seq", "risk_level", "score"
    )


@query
def analyzer_findings(spark, folder):
    """Line items as analyzer output: absolute, relative and climbing paths, missing fields."""
    path = scratch(spark, "analyzer")
    n, file = F.col("l_linenumber"), F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py"))
    before = views.pick(n, [F.lit("/scan/repo/"), F.lit("./lib/../"), F.lit("../"), F.lit("/scan/other/")])
    finding = F.struct(
        F.concat(before, F.when(n % 5 != 4, file).otherwise(F.lit("x//y.py"))).alias("path"),
        F.when(n % 2 == 0, F.struct(n.alias("line"))).alias("start"),
        F.when(n % 3 != 0, F.struct(F.lit("m").alias("message"), F.lit("ERROR").alias("severity"))).alias("extra"),
    )
    items = views.table(spark, folder, "lineitem")
    items.select(F.array(finding, F.struct(F.lit("").alias("path"), finding["start"].alias("start"), finding["extra"].alias("extra"))).alias("results")).write.json(path)
    return attach.static_by_file(tables.read_static_findings(spark, path, "repo", multiline=False), root="/scan/repo")


@query
def source_trees(spark, folder):
    """Documents written as a tree of files below a folder per source, read as source files."""
    path = scratch(spark, "trees")
    documents = views.table(spark, folder, "documents")
    documents.select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    found = files.read_source_files(spark, path)
    return found.groupBy("repo_id").agg(F.sum(F.length("content")).alias("characters"))


# -------------------------------------------------------------------- streaming
def _scratch(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)


def _run(writer) -> None:
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()


@query
def stream_decisions(spark, folder):
    out = _scratch(spark, "audit")
    _run(call_streams.decide_stream(views.call_stream(spark, folder), policy.default_policy(), f"{out}/data", f"{out}/log"))
    audit = spark.read.parquet(f"{out}/data")
    return audit.select(
        F.col("call_ts").cast("timestamp_ntz").alias("call_ts"), "call_id", "action", "rule", "reason", "severity",
        "tool_name", "logged_arguments",
    )


@query
def stream_action_counts(spark, folder):
    out = _scratch(spark, "counts")
    decided = policy.decide(views.call_stream(spark, folder), policy.default_policy())
    _run(call_streams.count_stream(call_streams.action_counts(decided), f"{out}/data", f"{out}/log", mode="update"))
    counts = call_streams.latest_counts(spark.read.parquet(f"{out}/data"))
    return counts.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "action", "calls",
    )


@query
def stream_latest_scores(spark, folder):
    out = _scratch(spark, "scores")
    keyed = history.with_key(views.scan_stream(spark, folder))
    _run(scan_streams.store_stream(keyed, f"{out}/data", f"{out}/log"))
    return scan_streams.latest_scores(spark, f"{out}/data")
