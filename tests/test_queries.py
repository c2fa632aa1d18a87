"""Every registered query against its SQL on the smallest tables, and the seeds' coverage."""

import pytest

from compare import connect, difference

import __spark_entry__ as entry
from toolguard import scale
from toolguard.queries import oracle, registry

FOLDER = "/root/testdata/sf0.001"
STATEMENTS = oracle.statements()


def test_every_query_has_a_statement():
    assert set(STATEMENTS) == set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_same_result_as_sql(spark, name):
    found = registry.QUERIES[name](spark, FOLDER).toPandas()
    expected = connect(FOLDER).execute(STATEMENTS[name]).fetchdf()
    assert difference(found, expected) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1000


def test_seeds_reach_every_branch(spark):
    def values(name, column):
        return {r[0] for r in registry.QUERIES[name](spark, FOLDER).select(column).distinct().collect()}

    assert values("policy_decisions", "action") == {"ALLOW", "BLOCK", "REQUIRE_APPROVAL", "LOG"}
    assert len(values("policy_decisions", "rule")) == 6
    assert values("risk_levels", "risk_level") == {"CRITICAL", "HIGH", "MEDIUM", "LOW"}
    assert values("tool_report", "score") == {"RED", "YELLOW", "GREEN"}
    assert values("overall_scores", "overall") == {"RED", "YELLOW", "GREEN", "UNKNOWN"}
    assert values("blast_radius", "label") == {"CRITICAL", "HIGH", "MEDIUM", "LOW"}
    assert values("gate_lenient", "passed") == {True, False}
    assert values("badges", "message") == {"passing", "warnings", "failing"}


@pytest.mark.parametrize("name", ["tool_behavior", "duplicate_files", "vulnerable_packages", "tool_report", "corpus_report"])
def test_hot_branches_give_the_same_rows(spark, monkeypatch, name):
    monkeypatch.setattr(scale, "HOT_FLOOR", 1)  # every repeated key is salted
    found = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert difference(found, connect(FOLDER).execute(STATEMENTS[name]).fetchdf()) is None
