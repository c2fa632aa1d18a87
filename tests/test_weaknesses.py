"""Vulnerable packages where pins and advisories both are many."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from toolguard import rules, scale, schemas
from toolguard.operators import gate, packages


@pytest.fixture(scope="module")
def inputs(spark):
    pins = [(f"r{i % 50}", i // 50, p, v) for i, (p, v) in enumerate([("flask", "2.0.0"), ("flask", "3.0"), ("left", "1.1"), ("left", None), (None, "1")] * 60)]
    # Every severity, listed or in a range, some told twice, some beside a range of the same advisory.
    told = [("PyPI", ("flask", "left", None)[i % 3], ["2.0.0", "1.1"] if i % 4 else None, "1.0" if i % 5 else None, "2.1", f"A{i % 90}", f"s{i % 30}", None, ("LOW", "MEDIUM", "HIGH", "CRITICAL", None)[i % 5]) for i in range(120)]
    return spark.createDataFrame(pins, "repo_id string, line_no int, package string, version string"), spark.createDataFrame(told, schemas.ADVISORIES)


def plain(pins, advisories):
    """All pairs, by a loop; versions here compare as numbers."""
    number = lambda v: [*map(int, v.removesuffix(".0").removesuffix(".0").split("."))]
    found = []
    for r in pins.collect():
        covers = set()
        for a in advisories.collect():
            if r.package and r.package == a.package and r.version:
                inside = a.introduced and number(a.introduced) <= number(r.version) and (not a.fixed or number(r.version) < number(a.fixed))
                if r.version in (a.versions or []) or inside:
                    covers.add((a.id, a.summary, a.severity))
        found += [(r.repo_id, r.line_no, r.package, r.version, *c) for c in covers]
    return Counter(found)


def test_vulnerabilities_and_weaknesses_against_all_pairs(inputs):
    want = plain(*inputs)
    columns = ["repo_id", "line_no", "package", "version", "vuln_id", "summary", "severity"]
    assert Counter(map(tuple, packages.vulnerabilities(*inputs).select(columns).collect())) == want
    counted = Counter()
    for (repo, line, package, version, _, _, severity), n in want.items():
        counted[repo, line, package, version, severity] += n
    found = packages.weaknesses(*inputs).collect()
    assert {(r.repo_id, r.line_no, r.package, r.version, r.severity): r.advisories for r in found} == counted
    assert len(found) == len(counted)


def test_gates_need_a_row_a_severity_only(spark, inputs):
    """Failures of the gates are the same from counts as from all pairs."""
    report = spark.createDataFrame([], "repo_id string, file string, seq long, name string, score string, shadowing_count long, injection_findings array<struct<severity:string>>")
    leaked = spark.createDataFrame([], "repo_id string, file string, ord int, type string, confidence string")
    squats = spark.createDataFrame([], "repo_id string, package string")
    whole, few = packages.vulnerabilities(*inputs), packages.weaknesses(*inputs)
    repos = inputs[0].select("repo_id").distinct()
    assert few.count() * 5 < whole.count()
    for levels in rules.PRESETS.values():
        one, other = (Counter(map(tuple, gate.failures(report, leaked, v, squats, levels).collect())) for v in (whole, few))
        assert one == other and one
        one, other = (Counter(map(tuple, gate.findings_per_repo(repos, report, leaked, v, squats, levels).collect())) for v in (whole, few))
        assert one == other
    one, other = (Counter(map(tuple, packages.dependency_summary(repos, inputs[0], v, repos).collect())) for v in (whole, few))
    assert one == other


def test_queries_that_count_packages_make_no_pairs(spark):
    from toolguard.queries import registry

    folder = "/root/testdata/sf0.01"
    vulnerable = registry.gated(spark, folder)[2]
    assert vulnerable.count() < registry.vulnerable_packages(spark, folder).count()
    assert vulnerable.groupBy("repo_id", "line_no", "severity").count().where("count > 1").isEmpty()


def test_a_large_result_is_even_over_the_tasks(spark):
    left = spark.range(2000).select(F.lit("k").alias("k"), "id").union(spark.range(5).select(F.lit(None).cast("string"), "id"))
    right = spark.range(500).select(F.lit("k").alias("k"), F.col("id").alias("other"))
    sizes = spark.createDataFrame([("k", 1_000_000)], "k string, made long")
    found = scale.expanding_join(left, right, ["k"], sizes, spread=["id"], made=10_000)
    held = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(held) == 1_000_000 == found.distinct().count()
    assert max(held) <= 100_000


def test_expanding_join_repeats_both_sides_alike(spark):
    """Cut into a grid, a key's rows go to as many pieces as the root of all pieces; only left rows were cut before."""
    left = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("a")).union(spark.createDataFrame([("rare", 7), (None, 8)], "k string, a long"))
    right = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("b")).union(spark.createDataFrame([("rare", 7), ("rare", 7), (None, 8)], "k string, b long"))
    sizes = spark.createDataFrame([("k", 1_000_000), ("rare", 2)], "k string, made long")
    found = scale.expanding_join(left, right, ["k"], sizes, spread=["a"], made=2500).withColumn("at", F.spark_partition_id()).cache()
    assert found.columns == ["k", "a", "b", "at"]
    assert found.where("k = 'k'").count() == found.where("k = 'k'").distinct().count() == 1_000_000
    assert found.where("k = 'rare'").count() == 2 and found.where("k is null").count() == 0
    for side in "ab":
        pieces = found.where("k = 'k'").groupBy(side).agg(F.countDistinct("at").alias("n")).agg(F.max("n")).first()[0]
        assert 1 < pieces <= 20, side  # of 400 in 800 partitions; a right row was in each of them
    found.unpersist()


def test_vulnerabilities_tell_what_is_asked(inputs):
    whole, names = packages.vulnerabilities(*inputs), packages.vulnerabilities(*inputs, tell=("vuln_id",))
    assert names.columns == [c for c in whole.columns if c not in ("summary", "text", "severity")]
    assert Counter(map(tuple, names.collect())) == Counter(map(tuple, whole.select(*names.columns).collect()))


def test_guidance_is_added_to_rows_that_are_made_narrow(spark):
    """The texts are the same in each row, so the join that makes the rows does not copy them."""
    from toolguard.queries import registry

    plan = registry.repo_guidance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.strip(" :+-|") for line in plan.splitlines()]
    above = next(i for i, line in enumerate(lines) if line.startswith("Project") and ", dependency AS about" in line)
    assert "known, published vulnerability" in lines[above] and lines[above + 1].startswith("Repartition")
    assert "Join" not in lines[above + 1] and not any("known, published vulnerability" in line for line in lines[above + 1 :])
