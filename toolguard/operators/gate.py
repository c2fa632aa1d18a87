"""Overall scores, thresholds and the build decision, per repo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions.capabilities import lookup
from toolguard.functions.constants import constant

CATEGORIES = ("overall", "secrets", "dependencies", "typosquats", "tools")


def rank(severity: Column) -> Column:
    """Rank of a severity or score; unknown ones rank 0."""
    return lookup(severity, rules.SEVERITY_RANK, 0)


def meets(severity: Column, threshold: str) -> Column:
    """True where a severity reaches the threshold."""
    return rank(severity) >= rules.SEVERITY_RANK.get(threshold, 0)


def presets() -> dict[str, dict[str, str]]:
    return {name: dict(levels) for name, levels in rules.PRESETS.items()}


def _counts(df: DataFrame, **counted: Column) -> DataFrame:
    return df.groupBy("repo_id").agg(*[F.count_if(c).alias(n) for n, c in counted.items()])


def findings_per_repo(
    repos: DataFrame,
    report: DataFrame,
    secrets: DataFrame,
    vulnerable: DataFrame,
    typosquats: DataFrame,
    thresholds: dict[str, str],
) -> DataFrame:
    """One row per repo with every count that scores and gates need.

    Each input is reduced to one row per repo by combinable counts before the
    joins, so a repo with most of the findings costs no more than any other.
    """
    limits = {**rules.EVALUATOR_DEFAULTS, **thresholds}
    true = F.lit(True)
    tool_fails = (
        meets(F.col("score"), limits["tool"])
        | F.exists("injection_findings", lambda f: meets(f["severity"], limits["injection"]))
        | ((F.col("shadowing_count") > 0) & meets(F.lit("HIGH"), limits["shadowing"]))
    )
    tools = _counts(
        report, tools=true, red=F.col("score") == "RED", yellow=F.col("score") == "YELLOW", failed_tools=tool_fails
    )
    leaked = _counts(
        secrets, secrets=true, failed_secrets=meets(F.coalesce("confidence", F.lit("LOW")), limits["secret"])
    )
    # One failure per package, however many advisories cover it.
    severe = meets(F.coalesce("severity", F.lit("MEDIUM")), limits["dependency"])
    per_package = vulnerable.groupBy("repo_id", "line_no").agg(F.bool_or(severe).alias("severe"))
    dependencies = _counts(per_package, vulnerable=true, failed_dependencies=F.col("severe"))
    squats = _counts(typosquats, typosquats=true)
    joined = reduce(
        lambda a, b: a.join(b, "repo_id", "left"), [tools, leaked, dependencies, squats], repos.select("repo_id")
    )
    return joined.select(
        "repo_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in joined.columns if c != "repo_id"]
    ).withColumn("overall", overall_score())


def overall_score() -> Column:
    """RED on any secret, vulnerable or look-alike package; else the worst tool score."""
    alarming = (F.col("secrets") > 0) | (F.col("vulnerable") > 0) | (F.col("typosquats") > 0)
    return (
        F.when(alarming | (F.col("red") > 0), "RED")
        .when(F.col("yellow") > 0, "YELLOW")
        .when(F.col("tools") > 0, "GREEN")
        .otherwise("UNKNOWN")
    )


def evaluate(found: DataFrame, thresholds: dict[str, str]) -> DataFrame:
    """One row per repo and category: passed, failures and threshold.

    ``found`` comes from ``findings_per_repo`` with the same thresholds.
    """
    limits = {**rules.EVALUATOR_DEFAULTS, **thresholds}
    typo_counts = rules.SEVERITY_RANK["MEDIUM"] >= rules.SEVERITY_RANK.get(limits["typosquat"], 0)
    overall_fails = meets(F.col("overall"), limits["overall"])

    def row(category: str, limit: str, failed: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            passed.alias("passed"),
            failed.cast("bigint").alias("failed_count"),
            F.lit(limits[limit]).alias("threshold"),
        )

    def counted(category: str, limit: str, column: str) -> Column:
        return row(category, limit, F.col(column), F.col(column) == 0)

    rows = F.array(
        row("overall", "overall", F.when(overall_fails, 1).otherwise(0), ~overall_fails),
        counted("secrets", "secret", "failed_secrets"),
        counted("dependencies", "dependency", "failed_dependencies"),
        row("typosquats", "typosquat", F.col("typosquats"), (F.col("typosquats") == 0) | F.lit(not typo_counts)),
        counted("tools", "tool", "failed_tools"),
    )
    return found.select("repo_id", F.col("overall").alias("overall_score"), F.explode(rows).alias("r")).select(
        "repo_id", "overall_score", "r.*"
    )


# ------------------------------------------------------- any number of presets
LIMITS = ("overall", "secret", "dependency", "typosquat", "tool", "injection", "shadowing")


def thresholds(spark: SparkSession, named: dict[str, dict[str, str]]) -> DataFrame:
    """(preset, limit, level, rank): thresholds as rows, defaults filled in."""
    rows = [
        (name, limit, level, rules.SEVERITY_RANK.get(level, 0))
        for name, levels in named.items()
        for limit in LIMITS
        for level in [{**rules.EVALUATOR_DEFAULTS, **levels}[limit]]
    ]
    return spark.createDataFrame(rows, "preset string, limit string, level string, rank int")


def histogram(repos: DataFrame, report: DataFrame, secrets: DataFrame, vulnerable: DataFrame, typosquats: DataFrame) -> DataFrame:
    """(repo_id, overall, counts): what gates look at, counted by rank, one row a repo whatever the thresholds.

    ``counts`` has (category, score, injection, shadowed, n): for tools the ranks of score and worst
    injection (-1 without one) and whether one is shadowed, for the others the rank of the severity as ``score``.
    A repo has some dozens of them.
    """
    none, no = F.lit(-1), F.lit(False)

    def kinds(df: DataFrame, category: str, score: Column, injection: Column = none, shadowed: Column = no) -> DataFrame:
        keys = [F.lit(category).alias("category"), score.alias("score"), injection.alias("injection"), shadowed.alias("shadowed")]
        # RED and YELLOW share ranks with severities, so the score's name tells what overall scores need.
        name = F.col("score") if category == "tools" else F.lit(None).cast("string")
        return df.select("repo_id", *keys, name.alias("name")).groupBy("repo_id", "category", "score", "injection", "shadowed", "name").agg(F.count(F.lit(1)).alias("n"))

    worst = F.coalesce(F.array_max(F.transform("injection_findings", lambda f: rank(f["severity"]))), none)
    tools = kinds(report, "tools", rank(F.col("score")), worst, F.coalesce(F.col("shadowing_count") > 0, no))
    leaked = kinds(secrets, "secrets", rank(F.coalesce("confidence", F.lit("LOW"))))
    # One failure per package, at its worst severity.
    per_package = vulnerable.groupBy("repo_id", "line_no").agg(F.max(rank(F.coalesce("severity", F.lit("MEDIUM")))).alias("worst"))
    weak = kinds(per_package, "dependencies", F.col("worst"))
    squats = kinds(typosquats, "typosquats", rank(F.lit("MEDIUM")))
    counted = tools.unionByName(leaked).unionByName(weak).unionByName(squats)
    total = lambda category, name=None: F.sum(
        F.when((F.col("category") == category) & (F.lit(True) if name is None else F.col("name") == name), F.col("n")).otherwise(0)
    )
    per_repo = counted.groupBy("repo_id").agg(
        F.collect_list(F.struct("category", "score", "injection", "shadowed", "n")).alias("counts"),
        total("secrets").alias("secrets"), total("dependencies").alias("vulnerable"), total("typosquats").alias("typosquats"),
        total("tools", "RED").alias("red"), total("tools", "YELLOW").alias("yellow"), total("tools").alias("tools"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("secrets", "vulnerable", "typosquats", "red", "yellow", "tools")]
    nothing = F.array().cast("array<struct<category:string,score:int,injection:int,shadowed:boolean,n:bigint>>")
    filled = repos.select("repo_id").join(per_repo, "repo_id", "left").select("repo_id", F.coalesce("counts", nothing).alias("counts"), *zero)
    return filled.select("repo_id", overall_score().alias("overall"), "counts")


def evaluate_all(found: DataFrame, limits: DataFrame) -> DataFrame:
    """(preset, repo_id, overall_score, category, passed, failed_count, threshold) of every preset of ``thresholds``.

    ``found`` comes from ``histogram``. Each row is a repo's histogram against one preset, so any
    number of presets costs no further look at tools, secrets or packages.
    """
    levels = F.map_from_entries(F.collect_list(F.struct("limit", F.struct("level", "rank"))))
    presets = limits.groupBy("preset").agg(levels.alias("levels"))
    # All presets in one row beside the constant, so that no repo meets them in a join.
    listed = presets.agg(F.collect_list(F.struct("preset", "levels")).alias("presets")).first()["presets"]
    table = [{"preset": p["preset"], **{k: {"level": p["levels"][k]["level"], "rank": p["levels"][k]["rank"]} for k in LIMITS}} for p in listed]
    rows = found.withColumn("p", F.explode(constant(sorted(table, key=lambda p: p["preset"]))))
    at = lambda limit: F.col(f"p.{limit}.rank")
    failed = lambda category, fails: F.aggregate(
        F.filter("counts", lambda c: (c["category"] == category) & fails(c)), F.lit(0).cast("bigint"), lambda a, c: a + c["n"]
    )
    reaches = lambda limit: lambda c: c["score"] >= at(limit)
    high = rules.SEVERITY_RANK["HIGH"]

    def tool_fails(c: Column) -> Column:
        return (c["score"] >= at("tool")) | ((c["injection"] >= 0) & (c["injection"] >= at("injection"))) | (c["shadowed"] & (F.lit(high) >= at("shadowing")))

    overall = rank(F.col("overall")) >= at("overall")
    squats = failed("typosquats", lambda c: F.lit(True))
    entry = lambda category, limit, count, passed=None: F.struct(
        F.lit(category).alias("category"), (count == 0 if passed is None else passed).alias("passed"), count.cast("bigint").alias("failed_count"),
        F.col(f"p.{limit}.level").alias("threshold"),
    )
    entries = F.array(
        entry("overall", "overall", F.when(overall, 1).otherwise(0)),
        entry("secrets", "secret", failed("secrets", reaches("secret"))),
        entry("dependencies", "dependency", failed("dependencies", reaches("dependency"))),
        entry("typosquats", "typosquat", squats, (squats == 0) | (F.lit(rules.SEVERITY_RANK["MEDIUM"]) < at("typosquat"))),
        entry("tools", "tool", failed("tools", tool_fails)),
    )
    return rows.select(F.col("p.preset").alias("preset"), "repo_id", F.col("overall").alias("overall_score"), F.explode(entries).alias("r")).select(
        "preset", "repo_id", "overall_score", "r.*"
    )


def failures(
    report: DataFrame, secrets: DataFrame, vulnerable: DataFrame, typosquats: DataFrame, thresholds: dict[str, str]
) -> DataFrame:
    """What fails the gates, one row an item: ``repo_id, category, item, severity, threshold``.

    A package fails once a requirement line, at its worst severity; a tool by its worst finding.
    """
    limits = {**rules.EVALUATOR_DEFAULTS, **thresholds}

    def rows(df: DataFrame, category: str, limit: str, item: Column, severity: Column) -> DataFrame:
        return df.select(
            "repo_id", F.lit(category).alias("category"), item.alias("item"), severity.alias("severity"), F.lit(limits[limit]).alias("threshold")
        )

    confidence = F.coalesce("confidence", F.lit("LOW"))
    leaked = secrets.where(meets(confidence, limits["secret"]))
    severity = F.coalesce("severity", F.lit("MEDIUM"))
    worst = (
        vulnerable.groupBy("repo_id", "line_no", "package", "version")
        .agg(F.max(F.struct(rank(severity).alias("rank"), severity.alias("severity"))).alias("worst"))
        .where(F.col("worst.rank") >= rules.SEVERITY_RANK.get(limits["dependency"], 0))
    )
    squats = typosquats.where(meets(F.lit("MEDIUM"), limits["typosquat"]))
    injected = F.array_max(F.transform("injection_findings", lambda f: F.struct(rank(f["severity"]).alias("rank"), f["severity"].alias("severity"))))
    shadowed = (F.col("shadowing_count") > 0) & meets(F.lit("HIGH"), limits["shadowing"])
    by_injection = F.coalesce(injected["rank"], F.lit(0)) >= rules.SEVERITY_RANK.get(limits["injection"], 0)
    by_injection = by_injection & (F.size("injection_findings") > 0)
    tool_severity = (
        F.when(meets(F.col("score"), limits["tool"]), F.col("score")).when(by_injection, injected["severity"]).when(shadowed, "HIGH")
    )
    place = F.concat_ws(":", "file", F.col("seq").cast("string"), "name")
    return (
        rows(leaked, "secrets", "secret", F.concat_ws(":", "file", F.col("ord").cast("string"), "type"), confidence)
        .unionByName(rows(worst, "dependencies", "dependency", F.concat(F.col("package"), F.lit("=="), F.col("version")), F.col("worst.severity")))
        .unionByName(rows(squats, "typosquats", "typosquat", F.col("package"), F.lit("MEDIUM")))
        .unionByName(rows(report, "tools", "tool", place, tool_severity).where(F.col("severity").isNotNull()))
    )


def decisions(evaluated: DataFrame, fail_on: str = "RED") -> DataFrame:
    """One row per repo: do all categories pass, does the build fail, and why."""
    legacy = lookup(F.col("overall_score"), rules.OVERALL_RANK, 0) >= rules.OVERALL_FAIL_RANK[fail_on]
    never = F.lit(fail_on == "NEVER")
    # Five rows per repo, all combinable.
    return (
        evaluated.groupBy("repo_id", "overall_score")
        .agg(F.bool_and("passed").alias("all_passed"))
        .withColumn("build_fails", ~never & (legacy | ~F.col("all_passed")))
        .withColumn(
            "failed_by",
            F.when(~F.col("build_fails"), "none").when(legacy, "overall score").otherwise("category threshold"),
        )
        .withColumn("exit_code", F.when(F.col("build_fails"), 1).otherwise(0))
    )
