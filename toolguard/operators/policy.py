"""Policies over tool calls: rules become one projection, first match wins.

A policy is a small mapping of the same shape as its JSON form.  ``decide``
turns its rules into a single CASE expression, so evaluating any number of
calls takes no shuffle and no Python worker, in a batch or in a stream.
"""

from __future__ import annotations

import copy
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import arguments as args
from toolguard.functions import regex
from toolguard.functions.constants import constant
from toolguard.scale import all_of, one_of

REGEX_MARKS = ("(", "\\")
REGEX_STARTS = ("^", ".*")
# Rules per CASE expression; a longer policy is evaluated in several steps.
RULES_PER_STEP = 100


def default_policy() -> dict:
    return copy.deepcopy(rules.DEFAULT_POLICY)


def validated(policy: dict) -> dict:
    """A copy whose actions are known; unknown severities become LOW."""
    policy = copy.deepcopy(policy)
    for position, rule in enumerate(policy.get("rules", [])):
        _check_action(rule, f"rule {position} ({rule.get('name', 'unnamed')})")
        if rule.get("severity", "LOW") not in rules.POLICY_SEVERITIES:
            rule["severity"] = "LOW"
    return policy


def add_rule(policy: dict, rule: dict) -> dict:
    """The policy with one more rule at the end."""
    _check_action(rule, "new rule")
    return {**policy, "rules": [*policy.get("rules", []), rule]}


def remove_rule(policy: dict, name: str) -> dict:
    """The policy without the rules of that name."""
    return {**policy, "rules": [r for r in policy.get("rules", []) if r.get("name") != name]}


def named_rule(name: str, action: str = "BLOCK", tool_name: str | None = None, capability: str | None = None) -> dict:
    """A rule from a name and up to two conditions, as the command line builds it."""
    match = {k: v for k, v in (("tool_name", tool_name), ("capability", capability)) if v}
    return {
        "name": name,
        "match": match,
        "action": action,
        "reason": f"User-added rule: {name}",
        "severity": "HIGH" if action == "BLOCK" else "MEDIUM",
    }


def _check_action(rule: dict, where: str) -> None:
    action = rule.get("action", "")
    if action not in rules.ACTIONS:
        raise ValueError(f"invalid action {action!r} in {where}; use one of {', '.join(sorted(rules.ACTIONS))}")


# ------------------------------------------------------------------ conditions
def text_matches(lowered: Column, pattern: str) -> Column:
    """Case-insensitive substring, or regex where the pattern looks like one.

    The pattern itself is lowercased first, escapes included; one that is no
    valid regex is a substring again.  All of that is settled while compiling: a
    pattern that means something else here, or nothing, is an error that names it.
    """
    pattern = str(pattern).lower()
    if pattern.startswith(REGEX_STARTS) or any(m in pattern for m in REGEX_MARKS):
        try:
            re.compile(pattern)
        except re.error:
            return lowered.contains(pattern)
        return lowered.rlike(_usable(regex.java(pattern, ignore_case=True), pattern))
    return lowered.contains(pattern)


def _usable(translated: str, pattern: str) -> str:
    """The translated pattern, tried out before any call is decided."""
    spark = SparkSession.active()
    try:
        spark.sql("SELECT rlike('', :pattern)", args={"pattern": translated}).first()
    except Exception as error:
        raise regex.Untranslatable(f"pattern {pattern!r} cannot be used") from error
    return translated


def _conditions(match: dict, arg_columns: dict[str, Column]) -> list[Column]:
    tool, description = F.lower("tool_name"), F.lower(F.coalesce("description", F.lit("")))
    found = []
    if "tool_name" in match:
        wanted = match["tool_name"]
        found.append(F.lit(False) if wanted is None else text_matches(tool, wanted))
    if "tool_name_contains" in match:
        found.append(tool.contains(match["tool_name_contains"].lower()))
    if "description_contains" in match:
        found.append(description.contains(match["description_contains"].lower()))
    if "capability" in match:
        found.append(F.coalesce(F.array_contains("capabilities", match["capability"]), F.lit(False)))
    for name, pattern in match.get("arg_matches", {}).items():
        found.append(text_matches(arg_columns[name], pattern))
    for name, part in match.get("arg_value_contains", {}).items():
        found.append(arg_columns[name].contains(part.lower()))
    for name in match.get("arguments_not_empty", []):
        found.append(args.truthy(F.col("__args"), name))
    return found


def _argument_names(policy: dict) -> list[str]:
    names = {}
    for rule in policy["rules"]:
        match = rule.get("match", {})
        names.update(dict.fromkeys([*match.get("arg_matches", {}), *match.get("arg_value_contains", {})]))
    return list(names)


def _rule_condition(rule: dict, arg_columns: dict[str, Column]) -> Column:
    match = rule.get("match", {})
    conditions = _conditions(match, arg_columns)
    # "any" with an empty match has nothing to choose from and acts as "all".
    return one_of(conditions) if rule.get("match_type") == "any" and match else all_of(conditions)


def _outcome(action: str, rule: str, reason: str, severity: str) -> Column:
    return constant({"action": action, "rule": rule, "reason": reason, "severity": severity})


UNREADABLE = "unreadable_arguments"


def decide(calls: DataFrame, policy: dict) -> DataFrame:
    """Add ``call_id, action, rule, reason, severity, logged_arguments, arguments_unreadable`` to every call.

    Arguments that are no JSON object cannot be checked.  Such a call gets the policy's
    ``unreadable_action``, BLOCK unless it says otherwise, before any rule is tried.
    """
    policy = validated({"rules": [], **policy})
    unreadable_action = policy.get("unreadable_action", "BLOCK")
    _check_action({"action": unreadable_action}, "unreadable_action")
    default = policy.get("default_action", "ALLOW")
    names = _argument_names(policy)
    # Every argument that rules look at is rendered once, then shared by them.
    prepared = (
        calls.withColumn("tool_name", F.coalesce("tool_name", F.lit("unknown")))
        .withColumn("__args", args.parsed(F.col("arguments")))
        .withColumn("__texts", args.rule_texts(F.col("__args"), names))
    )
    columns = {n: F.try_element_at("__texts", F.lit(n)) for n in names}
    unreadable = _outcome(unreadable_action, UNREADABLE, "The arguments are not a JSON object", "HIGH")
    prepared = prepared.withColumn("__hit", F.when(F.col("__args.unreadable"), unreadable))
    for start in range(0, len(policy["rules"]), RULES_PER_STEP):
        case = F.when(F.col("__hit").isNotNull(), F.col("__hit"))
        for rule in policy["rules"][start : start + RULES_PER_STEP]:
            case = case.when(
                _rule_condition(rule, columns),
                _outcome(
                    rule["action"], rule.get("name", "unnamed rule"), rule.get("reason", ""), rule.get("severity", "LOW")
                ),
            )
        prepared = prepared.withColumn("__hit", case)
    fallback = _outcome(default, "default_action", f"No rule matched; using default action: {default}", "LOW")
    return (
        prepared.withColumn("__hit", F.coalesce("__hit", fallback))
        .withColumn("__entries", args.entries(F.col("__args")))
        .withColumns(
            {
                "call_id": args.call_id(F.col("tool_name"), args.canonical(F.col("__entries"))),
                "logged_arguments": args.log_form(F.col("__entries")),
            }
        )
        .select(
            *calls.columns,
            "call_id",
            "__hit.action",
            "__hit.rule",
            "__hit.reason",
            "__hit.severity",
            "logged_arguments",
            F.col("__args.unreadable").alias("arguments_unreadable"),
        )
    )


# -------------------------------------------------------------------- roll-ups
def totals(decisions: DataFrame) -> DataFrame:
    """Calls, blocked calls, calls awaiting approval, calls with unreadable arguments, and the exit code they imply."""
    blocked = F.count_if(F.col("action") == "BLOCK")
    return decisions.agg(
        F.count(F.lit(1)).alias("total_calls"),
        blocked.alias("blocked"),
        F.count_if(F.col("action") == "REQUIRE_APPROVAL").alias("require_approval"),
        F.count_if("arguments_unreadable").alias("unreadable"),
        F.when(blocked > 0, 1).otherwise(0).alias("exit_code"),
    )


def default_decisions(audit: DataFrame) -> DataFrame:
    """The second trail: only the calls that no rule matched."""
    return audit.where(F.col("rule") == "default_action").select(
        "call_ts", "tool_name", "action", "rule", "call_id"
    )
