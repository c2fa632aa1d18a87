"""The whole scan of a corpus: files to report, scores, gates and builds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolguard.functions import capabilities as caps
from toolguard.operators import extraction, gate, packages, report, secrets
from toolguard.scale import materialize, unnest
from toolguard.sources import files as sources
from toolguard.sources import requirements


@dataclass(frozen=True)
class Scan:
    """The tables that one scan of a corpus yields; all but ``report`` are lazy."""

    repos: DataFrame
    tools: DataFrame
    report: DataFrame
    secrets: DataFrame
    requirements: DataFrame
    vulnerable: DataFrame
    weaknesses: DataFrame
    typosquats: DataFrame
    languages: DataFrame

    def findings(self, thresholds: dict[str, str]) -> DataFrame:
        return gate.findings_per_repo(
            self.repos, self.report, self.secrets, self.weaknesses, self.typosquats, thresholds
        )

    def gates(self, thresholds: dict[str, str]) -> DataFrame:
        return gate.evaluate(self.findings(thresholds), thresholds)

    def builds(self, thresholds: dict[str, str], fail_on: str = "RED") -> DataFrame:
        """The build decision per repo, with ``fail_on`` as the overall threshold."""
        return gate.decisions(self.gates({**thresholds, "overall": fail_on}), fail_on)


def scan_files(files: DataFrame) -> DataFrame:
    """All that one pass over ``files(repo_id, path, content)`` finds, a row per file and without the contents.

    The table is written: tools, secrets, requirements and counts come from it by
    column, so the source text is read once and never shuffled.
    """
    path, content = F.col("path"), F.col("content")
    scanned = sources.is_python_source(path) | sources.is_js_source(path)
    language = F.when(scanned, caps.language(path))
    parsed = F.col("language").isNotNull() & extraction.can_hold_tools(F.col("language"), content)
    prepared = files.select("repo_id", path.alias("file"), language.alias("language"), "content", "path").select(
        "repo_id", "file", "language",
        F.when(parsed, caps.flags_by_language(content, F.col("language") == "JS/TS")).alias("file_flags"),
        secrets.found_in(content).alias("secrets"),
        F.when(path == "requirements.txt", requirements.pins(content)).alias("pins"),
        F.when(parsed, content).alias("content"),
    )
    return materialize(extraction.with_tools(prepared))


def scan_corpus(
    files: DataFrame, advisories: DataFrame, static_findings: DataFrame, verdicts: DataFrame | None = None
) -> Scan:
    """Scan ``files(repo_id, path, content)`` of any number of repositories."""
    scanned = scan_files(files)
    tools = extraction.tool_rows(scanned)
    pinned = unnest(scanned, ["repo_id"], F.col("pins"), "p").select("repo_id", "p.*")
    covered = packages.coverage(pinned, advisories)
    return Scan(
        repos=scanned.select("repo_id").distinct(),
        tools=tools,
        report=materialize(report.tool_report(tools, static_findings, verdicts)),
        secrets=secrets.as_rows(scanned, ["repo_id", "file"], F.col("secrets")),
        requirements=pinned,
        vulnerable=packages.vulnerabilities(pinned, advisories, covered=covered),
        weaknesses=packages.weaknesses(pinned, advisories, covered=covered),
        typosquats=packages.typosquats(pinned),
        languages=sources.language_counts(scanned.where(F.col("language").isNotNull())),
    )
