"""Policies on calls: conditions, order, ids, log form, files and edits."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from toolguard.functions import arguments as args
from toolguard.functions import regex
from toolguard.operators import policy
from toolguard.sources import tables


def calls(spark, *rows):
    full = [(i, n, None if a is None else json.dumps(a), d, c) for i, (n, a, d, c) in enumerate(rows)]
    schema = "i int, tool_name string, arguments string, description string, capabilities array<string>"
    return spark.createDataFrame(full, schema)


def decide(spark, name, arguments, capabilities=None, description=None, rules=None):
    chosen = rules or policy.default_policy()
    return policy.decide(calls(spark, (name, arguments, description, capabilities)), chosen).collect()[0]


def with_rule(match, first=True, **rule):
    base = policy.default_policy()
    added = {"name": "own", "match": match, "action": "BLOCK", "reason": "r", "severity": "HIGH", **rule}
    return {**base, "rules": [added, *base["rules"]] if first else [*base["rules"], added]}


@pytest.mark.parametrize(
    "name, arguments, capabilities, action, severity",
    [
        ("delete_files", {"command": "rm -rf /", "path": "/"}, ["subprocess_execution"], "BLOCK", "CRITICAL"),
        ("delete_files", {"command": "rm -rf /", "path": "/tmp"}, [], "ALLOW", "LOW"),
        ("get_weather", {"city": "Boston"}, None, "ALLOW", "LOW"),
        ("run_script", {"script": "ls"}, ["subprocess_execution"], "REQUIRE_APPROVAL", "HIGH"),
        ("get_config", {}, ["environment_access"], "REQUIRE_APPROVAL", "HIGH"),
        ("fetch", {"url": "http://example.com"}, ["network_access"], "BLOCK", "HIGH"),
        ("fetch", {"url": "http://0.0.0.0:80"}, [], "BLOCK", "HIGH"),
        ("fetch", {"url": "http://localhost"}, [], "ALLOW", "LOW"),
        ("rm", {"path": "delete"}, ["file_access"], "ALLOW", "LOW"),
        ("rm", {"path": "DELETE|remove|unlink|wipe"}, ["file_access"], "LOG", "MEDIUM"),
    ],
)
def test_default_policy(spark, name, arguments, capabilities, action, severity):
    got = decide(spark, name, arguments, capabilities)
    assert (got.action, got.severity) == (action, severity)


PATTERNS = [
    r"(?s)rm.*-rf", r"(?m)^rm$", r"rm$", r"^rm", r"(?a)rm(\w)", r"(?i)rm", r"a(?i:b)c", r"(?i)a(?-i:b)c", r"(?s:.)x", r"a.b", r"(?P<x>a)(?P=x)",
    r"(?P<a_b>r)m", r"\bfoo\b", r"\Bm", r"a(?#c)b", r"[\W]x", r"[^\W\d]+", r"\d{2,}", r"x{,2}y", r"x{}", r"[a[b]", r"[&&a]", r"a\v", r"\x41",
    r"\u0041", r"(a)\1", r"\101", r"[\1]", r"\0", r"(?:a|b)+?c", r"(?=a)a", r"(?<!b)m", r"(?>a+)b", r"a++b", r"\Arm\Z", r"é\w", r"\s", r"(?a)\s",
    r"^$", r"(?m)$", r"(?ms)^a.b$", r"(?i)ſ", r"[]a]", r"[^]a]", r"(?<=a)b", r"(|x)y", r"(?a:\w)é", r"\ba\B", r"(?m:^)b", r"\.\/\-",
]
TEXTS = [
    "rm\n-rf", "ls\nrm\nx", "rm", "rm\n", "x rm", "RM", "aBc", "abc", "ABC", "a\nx", "a\nb", "aab", "aa", "foo bar", "xfoo", "ab", "é x", "12", "xxy",
    "y", "x{}", "[", "b", "&", "a", "a\x0b", "A", "\x01", "\x00", "bc", "m", "bm", "é_", "ü", "\u2003", "\x85", "", "\n", "aa\nb", "K", "ſ", "s", "]",
    "^", "./-", "aé", "eé", "rmé",
]


def test_patterns_with_flags_match_as_in_python(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for row in frame.select("t", *(F.col("t").rlike(regex.java(p)).alias(f"p{n}") for n, p in enumerate(PATTERNS))).collect():
        assert [bool(re.search(p, row.t)) for p in PATTERNS] == list(row[1:]), row.t


@pytest.mark.parametrize("pattern", [r"(a)?(?(1)b|c)", r"(?x)a (b)", r"(\N{digit one})"])
def test_patterns_without_an_equal_are_refused(spark, pattern):
    with pytest.raises(regex.Untranslatable):
        regex.java(pattern)
    if not pattern.startswith(r"(\N"):  # in lower case it is no pattern, so a substring
        with pytest.raises(ValueError, match="pattern"):
            decide(spark, "t", {"n": "b"}, rules=with_rule({"arg_matches": {"n": pattern}}))


@pytest.mark.parametrize("text", ['{"command": "rm -rf /"', "[1]", '"x"', "null", "1", "", "{]", "nonsense"])
def test_unreadable_arguments_are_not_allowed(spark, text):
    frame = spark.createDataFrame([("t", text, None, None)], "tool_name string, arguments string, description string, capabilities array<string>")
    got = policy.decide(frame, policy.default_policy()).first()
    assert (got.arguments_unreadable, got.action, got.rule) == (True, "BLOCK", "unreadable_arguments")
    asked = {**policy.default_policy(), "unreadable_action": "REQUIRE_APPROVAL"}
    assert policy.decide(frame, asked).first().action == "REQUIRE_APPROVAL"
    with pytest.raises(ValueError):
        policy.decide(frame, {"unreadable_action": "PASS"})


@pytest.mark.parametrize(
    "value", [{"b": 1, "a": 2}, ["null"], [1.0, 2], ["it's"], ['say "x"'], ['it\'s "x"'], {"k": [True, None, {"z": "\n\\\t"}]}, [], [[1.5, -2]], ["é"]]
)
def test_nested_arguments_print_as_in_python(spark, value):
    text = json.dumps({"n": value})
    row = spark.createDataFrame([(text,)], "a string").select(args.rule_text(args.parsed(F.col("a")), F.lit("n")).alias("t")).first()
    assert row.t == str(value).lower()


@pytest.mark.parametrize("value", [[1.0], [1.0, [2.50, "x y"]], {"b": [1, 2], "a": None}, ["é", True]])
def test_ids_of_nested_arguments(spark, value):
    wanted = json.dumps({"n": value}, sort_keys=True)
    got = decide(spark, "t", {"n": value})
    assert got.call_id == hashlib.sha256(f"t:{wanted}".encode()).hexdigest()[:16]


@pytest.mark.parametrize(
    "match, arguments, hit",
    [
        ({"arg_matches": {"path": r"^\/$"}}, {"path": "/"}, True),
        ({"arg_matches": {"path": r"^\/$"}}, {"path": "/tmp"}, False),
        ({"arg_matches": {"n": "^1.0$"}}, {"n": 1.0}, True),
        ({"arg_matches": {"n": r"\[1, 'a'\]"}}, {"n": [1, "A"]}, True),
        ({"arg_matches": {"n": "none"}}, {"n": None}, True),
        ({"arg_matches": {"n": "none"}}, {}, False),
        ({"arg_matches": {"n": "("}}, {"n": "a(b"}, True),
        ({"arg_matches": {"n": r"^a\Sb"}}, {"n": "a b"}, True),
        ({"arg_value_contains": {"n": "TRUE"}}, {"n": True}, True),
        ({"arguments_not_empty": ["n"]}, {"n": 0}, False),
        ({"arguments_not_empty": ["n"]}, {"n": [0]}, True),
        ({"arguments_not_empty": ["n"]}, {"n": ""}, False),
        ({"arguments_not_empty": ["n"]}, {}, False),
        ({"tool_name": "^my_"}, {}, True),
        ({"tool_name": "y_T"}, {}, True),
        ({"tool_name": None}, {}, False),
        ({"tool_name": "my", "description_contains": "missing"}, {}, False),
        ({}, {}, True),
    ],
)
def test_conditions(spark, match, arguments, hit):
    got = decide(spark, "my_tool", arguments, rules=with_rule(match))
    assert (got.rule == "own") is hit


def test_any_needs_one_condition(spark):
    rules = with_rule({"capability": "file_access", "arg_value_contains": {"url": "local"}}, match_type="any")
    assert decide(spark, "t", {"url": "x"}, ["file_access"], rules=rules).rule == "own"
    assert decide(spark, "t", {"url": "LOCAL"}, [], rules=rules).rule == "own"
    assert decide(spark, "t", {}, [], rules=rules).rule == "default_action"
    assert decide(spark, "t", {}, [], rules=with_rule({}, match_type="any")).rule == "own"
    assert decide(spark, "t", {}, [], rules=with_rule({"arg_matches": {}}, match_type="any")).rule == "default_action"


def test_first_rule_wins_across_steps(spark, monkeypatch):
    monkeypatch.setattr(policy, "RULES_PER_STEP", 2)
    rules = [{"name": f"r{i}", "match": {"tool_name": f"t{i // 2}$("}, "action": "LOG"} for i in range(9)]
    rules = [{**r, "match": {"tool_name": f"^t{i // 2}$"}} for i, r in enumerate(rules)]
    got = policy.decide(calls(spark, *[(f"t{i}", {}, None, None) for i in range(6)]), {"rules": rules, "default_action": "BLOCK"})
    assert [r.rule for r in got.orderBy("i").collect()] == ["r0", "r2", "r4", "r6", "r8", "default_action"]


ARGUMENTS = [
    {"a": 1}, {"b": 2.5, "a": "xé\n\u007f\U0001f600\x1f\"\\"}, {"c": [1, 2, {"z": 1, "y": "q,: \"h"}], "d": True, "e": None},
    {"f": 1.0, "g": 1e10, "h": 2**90, "k": -0.0, "l": 1e-4, "m": 1.5e-7, "n": 1e16, "o": 1234567.8, "q": 1e22}, {}, {"é": []},
]


@pytest.mark.parametrize("arguments", ARGUMENTS)
def test_call_id(spark, arguments):
    text = json.dumps(arguments, sort_keys=True)
    got = decide(spark, "tool", arguments)
    assert got.call_id == hashlib.sha256(f"tool:{text}".encode()).hexdigest()[:16]
    assert got.logged_arguments == text


def test_log_form_cuts_long_strings(spark):
    got = decide(spark, "t", {"a": "é" * 51, "b": "x" * 50, "c": ["y" * 60]})
    assert json.loads(got.logged_arguments) == {"a": "é" * 20 + "...[truncated]", "b": "x" * 50, "c": ["y" * 60]}


def test_edits_and_validation(spark):
    added = policy.add_rule(policy.default_policy(), policy.named_rule("temp", tool_name="anything"))
    assert decide(spark, "anything", {}, rules=added).action == "BLOCK"
    assert decide(spark, "anything", {}, rules=policy.remove_rule(added, "temp")).action == "ALLOW"
    with pytest.raises(ValueError, match="INVALID"):
        policy.add_rule(added, {"name": "bad", "action": "INVALID"})
    with pytest.raises(ValueError, match="INVALID"):
        policy.validated({"rules": [{"name": "bad", "match": {}, "action": "INVALID"}]})
    assert policy.validated({"rules": [{"action": "LOG", "severity": "odd"}]})["rules"][0]["severity"] == "LOW"
    assert policy.named_rule("n", "LOG", capability="file_access")["severity"] == "MEDIUM"


def test_policy_files(spark, tmp_path):
    custom = with_rule({"tool_name": "x", "arg_matches": {"p": "^a"}, "arguments_not_empty": ["p"]}, match_type="any")
    (tmp_path / "policy.json").write_text(tables.policy_json(custom))
    assert tables.read_policy(spark, str(tmp_path / "policy.json")) == custom
    assert tables.policy_from_json(tables.policy_json(custom)) == custom
    rows = tables.policy_rules(spark, custom).orderBy("rule_ord").collect()
    assert [r.name for r in rows] == [r["name"] for r in custom["rules"]]


def test_call_files_totals_and_trails(spark, tmp_path):
    (tmp_path / "calls.json").write_text(
        json.dumps(
            [
                {"tool_name": "a", "arguments": {"x": 1, "y": {"b": 1, "a": 2}}, "capabilities": ["subprocess_execution"]},
                {"arguments": {}}, {"tool_name": "f", "capabilities": ["network_access"], "call_ts": "2024-01-02T03:04:05"},
            ]
        )
    )
    decided = policy.decide(tables.read_calls(spark, str(tmp_path / "calls.json")), policy.default_policy())
    assert {r.tool_name for r in decided.collect()} == {"a", "unknown", "f"}
    assert policy.totals(decided).collect()[0] == (3, 1, 1, 0, 1)
    tables.append_audit(decided, str(tmp_path / "audit"))
    tables.append_audit(decided, str(tmp_path / "audit"))
    audit = tables.read_audit(spark, str(tmp_path / "audit"))
    assert audit.count() == 6
    assert {r.tool_name for r in policy.default_decisions(audit).collect()} == {"unknown"}
