"""Interval joins, look-alikes of any list, thresholds as rows, and policies as tables."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.operators import gate, packages, policy, tenants
from toolguard.operators.ranges import points_in_ranges
from toolguard.queries import extended, registry, views

FOLDER = "/root/testdata/sf0.001"


def test_points_in_ranges_against_all_pairs(spark):
    r = random.Random(3)
    points = [(i, r.choice(["a", "b", "c", None]), r.choice([*range(40), None])) for i in range(300)]
    ranges = []
    for i in range(200):
        low = r.choice([*range(-5, 45), None])
        ranges.append((i, r.choice(["a", "b", "d", None]), low, r.choice([None, (low or 0) + r.randrange(-3, 30)])))
    want = {(p, q) for p, k, x in points for q, m, a, b in ranges if k and k == m and x is not None and a is not None and a <= x and (b is None or x < b)}
    left = spark.createDataFrame(points, "p int, k string, x int")
    right = spark.createDataFrame(ranges, "q int, k string, a int, b int")
    got = [(x["p"], x["q"]) for x in points_in_ranges(left, right, "k", "x", "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert points_in_ranges(left.limit(0), right, "k", "x", "a", "b").count() == 0


def test_one_package_with_very_many_versions_and_ranges(spark):
    # All pairs would be 10 to the 10; the matches are 300,000 or so.
    text = lambda n: F.concat_ws(".", F.floor(n / 1000).cast("string"), (n % 1000).cast("string"))
    versions = spark.range(100_000).select(F.lit("p").alias("package"), text(F.col("id")).alias("version"))
    k = F.col("id")
    ranges = spark.range(100_000).select(F.lit("p").alias("package"), k.alias("advisory"), text(k).alias("introduced"), text(k + 3).alias("fixed"))
    found = packages.in_ranges(versions, ranges)
    n, low, high = found.agg(F.count(F.lit(1)), F.min("advisory"), F.max("advisory")).first()
    # "1.0" is "1" and below "1.1": each range holds its version and the two after it.
    assert n == 3 * 100_000 - 3 and (low, high) == (0, 99_999)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lookalikes_against_all_pairs(spark):
    r = random.Random(9)
    trusted = ["pip", "six", "", "flask", "requests", "numpy", "pandas", "panda", "éclair"]
    names = list(trusted) + [None, "Flask", "NUMPY"]
    for _ in range(300):
        name = list(r.choice(trusted))
        for _ in range(r.randrange(4)):
            i = r.randrange(len(name) + 1)
            name[i : i + r.randrange(2)] = r.choice(["", "x", "s", "é", "p"])
        names.append("".join(name))
    want = {}
    for name in {n for n in names if n is not None}:
        near = sorted((plain_distance(name.lower(), t), t) for t in trusted)
        near = [(d, t) for d, t in near if 0 < d <= (1 if len(t) <= 4 else 2)]
        if name.lower() not in trusted and near:
            want[name] = near[0]
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    found = packages.lookalikes(frame(names), frame(trusted))
    assert {x["name"]: (x["distance"], x["resembles"]) for x in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    # The fixed list gives the same.
    fixed = list(rules.TRUSTED_PACKAGES)
    pins = spark.createDataFrame([("r", i, n, "1") for i, n in enumerate(["reqeusts", "numpyy", "djago", "flask", "pips", "tqmd", "panda", "xx"])], "repo_id string, line_no int, package string, version string")
    old = {x["package"]: (x["resembles"], x["distance"]) for x in packages.typosquats(pins).collect()}
    assert {x["name"]: (x["resembles"], x["distance"]) for x in packages.lookalikes(pins.select(F.col("package").alias("name")), frame(fixed)).collect()} == old


@pytest.fixture(scope="module")
def gated(spark):
    return registry.gated(spark, FOLDER)


def test_presets_as_rows_equal_single_presets(spark, gated):
    repos = views.repos(spark, FOLDER)
    found = gate.evaluate_all(gate.histogram(repos, *gated), gate.thresholds(spark, extended.PRESETS)).collect()
    for name in ("default", "nightly"):
        levels = extended.PRESETS[name]
        single = gate.evaluate(gate.findings_per_repo(repos, *gated, levels), levels).collect()
        assert Counter(tuple(x)[1:] for x in found if x["preset"] == name) == Counter(map(tuple, single))


# ------------------------------------------------------------------- policies
RULES = [
    {"name": "one", "match": {"tool_name": "delete", "arg_matches": {"path": "^/$"}}, "action": "BLOCK", "reason": "r", "severity": "HIGH"},
    {"name": "two", "match": {"capability": "network_access"}, "action": "REQUIRE_APPROVAL", "severity": "odd"},
    {"name": "three", "match_type": "any", "match": {"arg_value_contains": {"token": "ABC9"}, "description_contains": "Upload"}, "action": "LOG"},
    {"name": "four", "match": {"arguments_not_empty": ["script"], "tool_name_contains": "VIEW"}, "action": "BLOCK"},
    {"name": "five", "match": {"arg_value_contains": {"n": ""}, "tool_name": "("}, "action": "BLOCK"},
    {"name": "six", "match_type": "any", "match": {"arg_matches": {"list": r"\[1, \d+\]"}, "capability": "file_access"}, "action": "BLOCK"},
    {"name": "seven", "match": {"tool_name": None}, "action": "BLOCK"},
    {"name": "eight", "match": {"arg_value_contains": {"a": "é1"}}, "action": "LOG"},
]


def test_rules_as_rows_equal_one_policy(spark):
    calls = views.calls(spark, FOLDER)
    broken = F.when(F.col("event_id") % 11 == 1, F.lit("{")).otherwise(F.col("arguments"))
    calls = calls.withColumn("arguments", broken).withColumn("tenant", F.when(F.col("event_id") % 3 != 2, (F.col("event_id") % 3).cast("string")))
    rows = [(t, i, json.dumps(r)) for t, chosen in (("0", RULES), ("1", [*RULES[5:], {"name": "all", "match": {}, "action": "LOG", "reason": "é"}])) for i, r in enumerate(chosen)]
    compiled = tenants.policy_rules(spark.createDataFrame(rows, "tenant string, rule_ord int, rule string"))
    policies = spark.createDataFrame([("0", "LOG", "LOG")], "tenant string, default_action string, unreadable_action string")
    found = tenants.decide(calls, compiled, policies)
    columns = ["event_id", "call_id", "action", "rule", "reason", "severity", "logged_arguments", "arguments_unreadable"]
    got = Counter(tuple(x) for x in found.select("tenant", *columns).collect())
    want = Counter()
    for tenant, own in (("0", {"rules": RULES, "default_action": "LOG", "unreadable_action": "LOG"}), ("1", {"rules": [*RULES[5:], {"name": "all", "match": {}, "action": "LOG", "reason": "é"}]}), (None, {"rules": []})):
        part = calls.where(F.col("tenant").eqNullSafe(F.lit(tenant)))
        want += Counter((tenant, *x) for x in policy.decide(part, own).select(*columns).collect())
    assert got == want
    assert {x[3] for x in got} >= {"block".upper(), "LOG", "REQUIRE_APPROVAL", "ALLOW"}


def test_many_rules_make_no_larger_plan(spark):
    calls = views.calls(spark, FOLDER).withColumn("tenant", (F.col("event_id") % 2).cast("string"))

    def rows(n):
        made = [{"name": f"r{i}", "match": {"arg_value_contains": {"token": f"abc{i}z", "q": f"x{i}"}}, "action": "BLOCK"} for i in range(n)]
        made.append({"name": "last", "match": {"tool_name_contains": "run_script"}, "action": "BLOCK"})
        return spark.createDataFrame([(str(t), i, json.dumps(r)) for t in (0, 1) for i, r in enumerate(made)], "tenant string, rule_ord int, rule string")

    few, many = (tenants.decide(calls, tenants.policy_rules(rows(n))) for n in (3, 5000))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(many) - size(few)) < 0.02 * size(few)
    assert Counter(x["rule"] for x in many.collect()) == Counter(x["rule"] for x in few.collect())


def test_an_unknown_action_is_an_error(spark):
    rows = spark.createDataFrame([("t", 0, '{"name": "n", "action": "DROP"}')], "tenant string, rule_ord int, rule string")
    with pytest.raises(Exception, match="DROP"):
        tenants.policy_rules(rows).collect()
