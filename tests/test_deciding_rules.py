"""Rules that ask the same are tried once."""

import json
from collections import Counter

from toolguard.operators import policy, tenants


def test_of_rules_that_ask_the_same_the_first_decides(spark, monkeypatch):
    either = {"arg_value_contains": {"token": "abc", "a": "xyz"}}
    kinds = [
        {"match": {"tool_name_contains": "view", "description_contains": "report"}}, {"match": {"description_contains": "report", "tool_name_contains": "view"}},
        {"match": either}, {"match": either, "match_type": "any"}, {"match": {"capability": "file_access"}}, {"match": {"tool_name": None}},
    ]
    rules = [{**kinds[i % 6], "name": f"r{i}", "action": ("LOG", "BLOCK")[i % 2], "reason": f"of {i}"} for i in range(600, 0, -1)]
    rows = [(t, i, json.dumps(r)) for t in ("0", "1", None) for i, r in enumerate(rules if t == "0" else rules[7:])]
    calls = spark.createDataFrame(
        [(i, ("0", "1", None)[i % 3], ("View it", "other", None)[i % 4 % 3], ("A report", None)[i % 2], ('{"token": "1abc"}', '{"a": "xyz", "token": "abc"}', "{}", "[")[i % 5 % 4], (["file_access"], [], None)[i % 7 % 3]) for i in range(200)],
        "event_id int, tenant string, tool_name string, description string, arguments string, capabilities array<string>",
    )
    tried = []
    index = tenants.index
    monkeypatch.setattr(tenants, "index", lambda held, keys: (tried.append(held.count()), index(held, keys))[1])
    found = tenants.decide(calls, tenants.policy_rules(spark.createDataFrame(rows, "tenant string, rule_ord int, rule string")))
    columns = ["event_id", "action", "rule", "reason", "severity", "arguments_unreadable"]
    want = Counter()
    for tenant, own in (("0", rules), ("1", rules[7:]), (None, [])):
        part = calls.where("tenant is null" if tenant is None else f"tenant = '{tenant}'").drop("tenant")
        want += Counter(map(tuple, policy.decide(part, {"rules": own}).select(*columns).collect()))
    assert Counter(map(tuple, found.select(*columns).collect())) == want
    assert tried == [15]  # five different rules a tenant, of 600
