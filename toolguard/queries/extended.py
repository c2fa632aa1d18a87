"""Queries over trees, ranges, look-alikes and policies held as tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.operators import extraction, gate, packages, tenants
from toolguard.queries import views
from toolguard.queries.registry import gated, listed, query
from toolguard.scale import materialize, scratch
from toolguard.sources import files, trees

SQL: dict[str, str] = {}
PRESETS = {**rules.PRESETS, "nightly": {**rules.PRESETS["lenient"], "overall": "YELLOW", "secret": "LOW", "injection": "CRITICAL", "shadowing": "HIGH", "tool": "NONE"}}


# --------------------------------------------------------------------- trees
def written_tree(spark: SparkSession, folder: str) -> str:
    """Every document as a source file in a tree on disk, a third of them once more below version control."""
    root = scratch(spark, "trees")
    rows = views.source_files(spark, folder).select(F.concat_ws("/", "repo_id", "path").alias("tree_path"), "content", "repo_id", "path")
    again = rows.where(F.col("path").rlike("[147]\\.(?:py|ts)$")).withColumn("tree_path", F.concat_ws("/", "repo_id", F.lit(".git/objects"), "path"))
    trees.write_files(rows.unionByName(again), root)
    return root


@query
def pruned_trees(spark, folder):
    """Files of a tree with their sizes; the Python sources among them are loaded, nothing else."""
    root = written_tree(spark, folder)
    found = materialize(trees.list_repos(spark, root))
    python = found.where(files.is_python_source(F.col("path")))
    loaded = trees.with_contents(trees.spread(python), root).select("tree_path", F.length(files.decoded(F.col("bytes"))).alias("characters"))
    return found.join(loaded, "tree_path", "left").select("repo_id", "path", "size", F.coalesce("characters", F.lit(0)).alias("characters"))


LEFT_OUT = ", ".join(f"'{n}'" for n in trees.LEFT_OUT)
SQL["pruned_trees"] = f"""SELECT repo_id, path, strlen(content) AS size,
CASE WHEN doc_id IN (SELECT doc_id FROM sources_v WHERE language = 'Python') THEN CAST(length(content) AS INTEGER) ELSE 0 END AS characters
FROM files_v WHERE NOT list_has_any(string_split(lower(path), '/'), [{LEFT_OUT}])"""


@query
def extracted_once(spark, folder):
    """Tools of a tree, each different content parsed once."""
    root = written_tree(spark, folder)
    found = extraction.extract_once(files.tool_sources(trees.list_repos(spark, root)), root)
    return found.withColumn("file_flags", listed(F.col("file_flags")))


SQL["extracted_once"] = "SELECT * FROM extracted_v"


# ------------------------------------------------------------------ packages
def versions(spark: SparkSession, folder: str) -> DataFrame:
    """A package and version per line item, each once."""
    item = views.table(spark, folder, "lineitem")
    parts = [F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_partkey") % 50]
    version = F.concat_ws(".", *(p.cast("string") for p in parts))
    return item.select(F.concat(F.lit("pkg"), (F.col("l_suppkey") % 9).cast("string")).alias("package"), version.alias("version")).distinct()


def advised_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """A range of versions per order, some without an end."""
    k, minor = F.col("o_orderkey"), F.col("o_custkey") % 50
    major = (1 + k % 7).cast("string")
    return views.table(spark, folder, "orders").select(
        F.concat(F.lit("pkg"), (F.col("o_custkey") % 9).cast("string")).alias("package"), k.alias("advisory"),
        F.concat_ws(".", major, minor.cast("string")).alias("introduced"),
        F.when(k % 1000 != 0, F.concat_ws(".", major, (minor + 1 + k % 2).cast("string"), F.lit("0"))).alias("fixed"),
    )


@query
def vulnerable_ranges(spark, folder):
    """How many ranges hold a version, and the first of them."""
    found = packages.ranges_of(versions(spark, folder), advised_ranges(spark, folder), "advisory")
    return found.select("package", "version", F.col("n").alias("advisories"), F.col("first").alias("first_advisory"))


SQL["vulnerable_ranges"] = """WITH v AS (
SELECT DISTINCT 'pkg' || (l_suppkey % 9) AS package, CAST(l_linenumber AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS b, l_partkey % 50 AS c FROM lineitem
), r AS (
SELECT 'pkg' || (o_custkey % 9) AS package, o_orderkey AS advisory, 1 + o_orderkey % 7 AS a, o_custkey % 50 AS b,
CASE WHEN o_orderkey % 1000 <> 0 THEN o_custkey % 50 + 1 + o_orderkey % 2 END AS e FROM orders
)
SELECT package, v.a || '.' || v.b || '.' || c AS version, count(*) AS advisories, min(advisory) AS first_advisory
FROM v JOIN r USING (package) WHERE (v.a > r.a OR (v.a = r.a AND v.b >= r.b)) AND (e IS NULL OR v.a < r.a OR (v.a = r.a AND v.b < e)) GROUP BY ALL"""


def part_names(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_size").cast("string")).alias("name"))


@query
def lookalikes_of_parts(spark, folder):
    """Names of parts that resemble one that several parts have."""
    names = part_names(spark, folder)
    popular = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    return packages.lookalikes(names, popular)


SQL["lookalikes_of_parts"] = """WITH n AS (
SELECT replace(p_name, ' ', '-') || p_size AS name, count(*) AS n FROM part GROUP BY 1
), t AS (SELECT name FROM n WHERE n > 1)
SELECT name, resembles, CAST(distance AS INTEGER) AS distance FROM (
SELECT n.name, t.name AS resembles, levenshtein(n.name, t.name) AS distance,
row_number() OVER (PARTITION BY n.name ORDER BY levenshtein(n.name, t.name), t.name) AS place
FROM n JOIN t ON levenshtein(n.name, t.name) BETWEEN 1 AND CASE WHEN length(t.name) <= 4 THEN 1 ELSE 2 END
WHERE n.name NOT IN (SELECT name FROM t)) WHERE place = 1"""


# ------------------------------------------------------------------- policies
TENANTS = 5
EVENT_TYPES = ["click", "view", "purchase", "error", "signup"]
ACTIONS = ["BLOCK", "LOG", "REQUIRE_APPROVAL"]


def tenant_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rule per customer, as JSON, dealt over a few tenants: literals, names, capabilities, any of two, patterns."""
    k = F.col("c_custkey")
    number = (k % 100).cast("string")
    quoted = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    token = quoted('{"arg_value_contains": {"token": "abc', number, '"}}')
    named = quoted('{"tool_name_contains": "', views.pick(k, [F.lit(t.upper()) for t in EVENT_TYPES]), '", "description_contains": "REPORT"}')
    able = F.lit('{"capability": "file_access", "tool_name": "^Upload$", "arguments_not_empty": ["script"]}')
    either = quoted('{"arg_value_contains": {"a": "\u00e9', number, '", "token": "abc', number, '"}}')
    pattern = quoted('{"arg_matches": {"list": "^\\\\[1, ', number, '\\\\]$"}}')
    kind = F.floor(k / TENANTS)
    match = views.pick(kind, [token, named, able, either, pattern])
    way = F.when(kind % 5 == 3, ', "match_type": "any"').otherwise("")
    rule = quoted('{"name": "rule ', k.cast("string"), '", "action": "', views.pick(k, [F.lit(a) for a in ACTIONS]), '", "reason": "of ', F.col("c_mktsegment"), '", "match": ', match, way, "}")
    return views.table(spark, folder, "customer").select((k % TENANTS).cast("string").alias("tenant"), k.alias("rule_ord"), rule.alias("rule"))


@query
def policy_by_tenant(spark, folder):
    """Every call by the rules of its user's tenant."""
    users = views.table(spark, folder, "events").select("event_id", (F.col("user_id") % TENANTS).cast("string").alias("tenant"))
    calls = views.calls(spark, folder).join(users, "event_id")
    policies = spark.createDataFrame([("0", "LOG", None), ("3", None, "LOG")], "tenant string, default_action string, unreadable_action string")
    decided = tenants.decide(calls, tenants.policy_rules(tenant_rules(spark, folder)), policies)
    return decided.select("event_id", "tenant", "call_id", "action", "rule", "reason", "severity", "logged_arguments")


TOKEN = "form = 5 AND contains(repeat('abc', 17) || user_id, 'abc' || (c_custkey % 100))"
SQL["policy_by_tenant"] = f"""SELECT * FROM (WITH m AS (
SELECT event_id, min(c_custkey) AS k FROM calls_v JOIN customer ON c_custkey % {TENANTS} = user_id % {TENANTS}
AND CASE (c_custkey // {TENANTS}) % 5 WHEN 0 THEN {TOKEN}
WHEN 1 THEN contains(lower(tool_name), CASE c_custkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'error' ELSE 'signup' END)
  AND contains(lower(coalesce(description, '')), 'report')
WHEN 2 THEN coalesce(list_contains(capabilities, 'file_access'), false) AND lower(tool_name) = 'upload' AND form = 8
WHEN 3 THEN ({TOKEN}) OR (form = 6 AND contains('\u00e9' || user_id, '\u00e9' || (c_custkey % 100)))
ELSE form = 8 AND user_id = c_custkey % 100 END GROUP BY event_id
)
SELECT event_id, CAST(user_id % {TENANTS} AS VARCHAR) AS tenant, substring(sha256(tool_name || ':' || canonical_arguments), 1, 16) AS call_id,
CASE WHEN k IS NULL THEN CASE WHEN user_id % {TENANTS} = 0 THEN 'LOG' ELSE 'ALLOW' END ELSE CASE k % 3 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'LOG' ELSE 'REQUIRE_APPROVAL' END END AS action,
coalesce('rule ' || k, 'default_action') AS rule,
CASE WHEN k IS NULL THEN 'No rule matched; using default action: ' || CASE WHEN user_id % {TENANTS} = 0 THEN 'LOG' ELSE 'ALLOW' END ELSE 'of ' || c_mktsegment END AS reason,
'LOW' AS severity, logged_arguments FROM calls_v LEFT JOIN m USING (event_id) LEFT JOIN customer ON c_custkey = k)"""


# --------------------------------------------------------------------- gates
@query
def gates_of_all_presets(spark, folder):
    """Every preset's gates from one histogram of what was found."""
    found = materialize(gate.histogram(views.repos(spark, folder), *gated(spark, folder)))
    return gate.evaluate_all(found, gate.thresholds(spark, PRESETS))
