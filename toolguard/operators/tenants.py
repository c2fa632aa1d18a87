"""Policies of many tenants, held as tables: rules change without a new plan.

Rules are rows, compiled to rows of conditions. An index names for each rule what a call must
hold to match at all: the rarest three letters of a literal, a capability, an argument's
name. Calls meet only the rules whose key they hold, conditions decide, and of all rules that
match the first one counts; of those that ask the same only the first is tried. Rules that no key
stands for are tried on every call of their tenant.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolguard import functions, rules
from toolguard.functions import arguments as args
from toolguard.functions import regex
from toolguard.scale import materialize, salted_join

REGEX_MARKS, REGEX_STARTS = ("(", "\\"), ("^", ".*")
UNREADABLE = "unreadable_arguments"
CONDITION = "struct<field:string,argument:string,kind:string,text:string>"
RULE = f"tenant string, rule_ord bigint, name string, action string, reason string, severity string, any boolean, conditions array<{CONDITION}>"
#: Letters of the keys that stand for literals.
LETTERS = 3


def text_condition(field: str, argument: str | None, pattern) -> dict:
    """A substring, or a pattern where it looks like one and is one; in lower case, as single policies have it."""
    text = str(pattern).lower()
    if text.startswith(REGEX_STARTS) or any(m in text for m in REGEX_MARKS):
        try:
            re.compile(text)
        except re.error:
            return {"field": field, "argument": argument, "kind": "contains", "text": text}
        return {"field": field, "argument": argument, "kind": "regex", "text": regex.java(text, ignore_case=True)}
    return {"field": field, "argument": argument, "kind": "contains", "text": text}


def conditions(match: dict) -> list[dict]:
    """The conditions of a rule as rows: field, argument, kind (contains, regex, has, given, never), text."""
    plain = lambda field, argument, kind, text: {"field": field, "argument": argument, "kind": kind, "text": text}
    found = []
    if "tool_name" in match:
        wanted = match["tool_name"]
        found.append(plain("tool", None, "never", None) if wanted is None else text_condition("tool", None, wanted))
    if "tool_name_contains" in match:
        found.append(plain("tool", None, "contains", match["tool_name_contains"].lower()))
    if "description_contains" in match:
        found.append(plain("description", None, "contains", match["description_contains"].lower()))
    if "capability" in match:
        found.append(plain("capability", None, "has", match["capability"]))
    found += [text_condition("argument", name, pattern) for name, pattern in (match.get("arg_matches") or {}).items()]
    found += [plain("argument", name, "contains", part.lower()) for name, part in (match.get("arg_value_contains") or {}).items()]
    return found + [plain("argument", name, "given", None) for name in match.get("arguments_not_empty") or []]


def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules (tenant, rule_ord, rule as JSON) with their conditions; an unknown action is an error that names the rule."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("field", "argument", "kind", "text")]))
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for tenant, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            rule = json.loads(text)
            name, action, severity, match = rule.get("name", "unnamed rule"), rule.get("action", ""), rule.get("severity", "LOW"), rule.get("match") or {}
            if action not in rules.ACTIONS:
                raise ValueError(f"invalid action {action!r} in rule {name!r} of tenant {tenant!r}")
            values = (
                name, action, rule.get("reason", ""), severity if severity in rules.POLICY_SEVERITIES else "LOW",
                rule.get("match_type") == "any" and bool(match), conditions(match),
            )
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 4 + (pa.bool_(), kind), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["tenant", "rule_ord", "name", "action", "reason", "severity", "any", "conditions"])


def policy_rules(texts: DataFrame) -> DataFrame:
    """Compiled rules from ``texts`` (tenant, rule_ord, rule): a rule a row, as JSON of the form that policies have."""
    cloudpickle.register_pickle_by_value(functions)
    try:
        return texts.select(F.col("tenant").cast("string"), F.col("rule_ord").cast("bigint"), "rule").mapInArrow(compiled, RULE)
    finally:
        cloudpickle.unregister_pickle_by_value(functions)


def pieces(text: Column) -> Column:
    """The different runs of three letters in a text."""
    last = F.length(text) - (LETTERS - 1)
    return F.array_distinct(
        F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(LETTERS)))
    )


def _key(field: Column, value: Column) -> Column:
    return F.struct(field.alias("field"), value.alias("value"))


def call_keys(calls: DataFrame) -> DataFrame:
    """(row, tenant, field, value): what rules can ask of a call, each once."""
    of = lambda field, text: F.transform(pieces(text), lambda p: _key(F.lit(field), p))
    texts = F.flatten(F.transform(F.map_entries("__texts"), lambda e: F.transform(pieces(e["value"]), lambda p: _key(F.concat(F.lit("argument "), e["key"]), p))))
    given = F.transform("__given", lambda n: _key(F.lit("given"), n))
    able = F.transform(F.coalesce("capabilities", F.array().cast("array<string>")), lambda c: _key(F.lit("capability"), c))
    every = F.concat(of("tool", F.col("__tool")), of("description", F.col("__description")), texts, given, able)
    return calls.select("__row", "tenant", F.explode(F.array_distinct(every)).alias("k")).select("__row", "tenant", "k.field", "k.value")


def rule_keys(compiled_rules: DataFrame) -> DataFrame:
    """(tenant, rule_ord, any, place, keys): of each condition the keys that a call must hold; NULL where none stands for it."""
    rows = compiled_rules.select("tenant", "rule_ord", "any", F.posexplode_outer("conditions").alias("place", "c"))
    field = F.when(F.col("c.field") == "argument", F.concat(F.lit("argument "), "c.argument")).otherwise(F.col("c.field"))
    literal = (F.col("c.kind") == "contains") & (F.length("c.text") >= LETTERS)
    keys = (
        F.when(literal, F.transform(pieces(F.col("c.text")), lambda p: _key(field, p)))
        .when(F.col("c.kind") == "has", F.array(_key(F.lit("capability"), F.col("c.text"))))
        .when(F.col("c.kind") == "given", F.array(_key(F.lit("given"), F.col("c.argument"))))
    )
    return rows.select("tenant", "rule_ord", "any", "place", keys.alias("keys"))


def deciding(compiled_rules: DataFrame) -> DataFrame:
    """(tenant, rule_ord, any, conditions) of the rules that can be first: of a tenant's rules that ask the same, the first one."""
    asked = F.array_sort(F.array_distinct("conditions")).alias("conditions")
    return compiled_rules.groupBy("tenant", "any", asked).agg(F.min("rule_ord").alias("rule_ord")).select("tenant", "rule_ord", "any", "conditions")


def index(compiled_rules: DataFrame, keys_of_calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tenant, field, value, rule_ord) of indexed rules, and (tenant, rule_ord) of those to be tried on every call.

    A condition is known by its rarest key among the calls. A rule whose conditions all have to hold
    is indexed by the rarest of theirs, one of which any suffices by all of them.
    """
    keyed = materialize(rule_keys(compiled_rules))
    frequent = keys_of_calls.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    each = keyed.select("tenant", "rule_ord", "any", "place", F.explode("keys").alias("k")).select("tenant", "rule_ord", "any", "place", "k.*")
    counted = each.join(frequent, ["field", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = materialize(counted.groupBy("tenant", "rule_ord", "any", "place").agg(F.min(F.struct("n", "field", "value")).alias("k")))
    one = rarest.where(~F.col("any")).groupBy("tenant", "rule_ord").agg(F.min("k").alias("k"))
    chosen = one.unionByName(rarest.where("any").select("tenant", "rule_ord", "k"))
    # Without a key: a rule with no indexed condition, or one of which any suffices with some condition that has none.
    open_rules = keyed.groupBy("tenant", "rule_ord", "any").agg(F.bool_or(F.col("keys").isNull()).alias("some"), F.bool_and(F.col("keys").isNull()).alias("all"))
    wide = open_rules.where(F.when(F.col("any"), F.col("some")).otherwise(F.col("all"))).select("tenant", "rule_ord")
    known = chosen.join(wide, ["tenant", "rule_ord"], "left_anti")
    return known.select("tenant", "k.field", "k.value", "rule_ord").distinct(), wide


def holds(c: Column) -> Column:
    """Whether a call fulfils a condition, exactly."""
    text = F.when(c["field"] == "tool", F.col("__tool")).when(c["field"] == "description", F.col("__description")).otherwise(
        F.coalesce(F.try_element_at("__texts", c["argument"]), F.lit(""))
    )
    return F.coalesce(
        F.when(c["kind"] == "contains", F.contains(text, c["text"])).when(c["kind"] == "regex", F.rlike(text, c["text"]))
        .when(c["kind"] == "has", F.array_contains("capabilities", c["text"])).when(c["kind"] == "given", F.array_contains("__given", c["argument"])),
        F.lit(False),
    )


def decide(calls: DataFrame, compiled_rules: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Calls with what ``policy.decide`` adds, each by the rules of its ``tenant``.

    ``compiled_rules`` comes from ``policy_rules``; ``policies`` (tenant, default_action, unreadable_action) may leave
    tenants and values out: ALLOW and BLOCK. A call without a tenant meets no rule. The plan is the same for any number
    of rules and tenants; a tenant with most of the calls is salted.
    """
    parsed = calls.withColumn("tenant", F.col("tenant").cast("string")).withColumn("tool_name", F.coalesce("tool_name", F.lit("unknown")))
    parsed = parsed.withColumn("__args", args.parsed(F.col("arguments"))).withColumn("__entries", args.entries(F.col("__args")))
    names = F.map_keys("__args.plain")
    held = materialize(
        parsed.withColumns({
            "__tool": F.lower("tool_name"), "__description": F.lower(F.coalesce("description", F.lit(""))),
            "__texts": F.map_from_entries(F.transform(names, lambda n: F.struct(n, args.rule_text(F.col("__args"), n)))),
            "__given": F.filter(names, lambda n: args.truthy(F.col("__args"), n)),
            "call_id": args.call_id(F.col("tool_name"), args.canonical(F.col("__entries"))), "logged_arguments": args.log_form(F.col("__entries")),
            "arguments_unreadable": F.col("__args.unreadable"),
        }).drop("__args", "__entries").withColumn("__row", F.monotonically_increasing_id())
    )
    tried = held.where(~F.col("arguments_unreadable") & F.col("tenant").isNotNull())
    compiled_rules = materialize(compiled_rules)
    keys = materialize(call_keys(tried))
    tested = materialize(deciding(compiled_rules))
    known, wide = index(tested, keys)
    pairs = salted_join(keys, known, ["tenant", "field", "value"], "inner", spread=["__row"]).select("__row", "tenant", "rule_ord")
    pairs = pairs.unionByName(salted_join(tried.select("__row", "tenant"), wide, ["tenant"], "inner", spread=["__row"]).select("__row", "tenant", "rule_ord"))
    facts = tried.select("__row", "__tool", "__description", "__texts", "__given", "capabilities")
    asked = pairs.distinct().join(tested, ["tenant", "rule_ord"])
    matched = asked.join(facts, "__row").where(
        F.when(F.col("any"), F.exists("conditions", holds)).otherwise(F.forall("conditions", holds))
    )
    first = matched.groupBy("__row", "tenant").agg(F.min("rule_ord").alias("rule_ord"))
    outcome = compiled_rules.select("tenant", "rule_ord", F.struct("action", F.col("name").alias("rule"), "reason", "severity").alias("__hit"))
    hits = first.join(outcome, ["tenant", "rule_ord"]).select("__row", "__hit")
    if policies is None:
        policies = calls.sparkSession.createDataFrame([], "tenant string, default_action string, unreadable_action string")
    defaults = policies.select(F.col("tenant").cast("string").alias("tenant"), "default_action", "unreadable_action")
    found = held.join(hits, "__row", "left").join(defaults, "tenant", "left")
    action = F.coalesce("default_action", F.lit("ALLOW"))
    fallback = F.struct(action.alias("action"), F.lit("default_action").alias("rule"), F.concat(F.lit("No rule matched; using default action: "), action).alias("reason"), F.lit("LOW").alias("severity"))
    unreadable = F.struct(
        F.coalesce("unreadable_action", F.lit("BLOCK")).alias("action"), F.lit(UNREADABLE).alias("rule"),
        F.lit("The arguments are not a JSON object").alias("reason"), F.lit("HIGH").alias("severity"),
    )
    hit = F.when(F.col("arguments_unreadable"), unreadable).otherwise(F.coalesce("__hit", fallback))
    return found.withColumn("__hit", hit).select(*calls.columns, "call_id", "__hit.action", "__hit.rule", "__hit.reason", "__hit.severity", "logged_arguments", "arguments_unreadable")
