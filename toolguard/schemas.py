"""Schemas of the tables that jobs read and write."""

SOURCE_FILES = "repo_id STRING, path STRING, content STRING"
TOOLS = (
    "repo_id STRING, file STRING, language STRING, seq BIGINT, name STRING, "
    "description STRING, code_snippet STRING"
)
STATIC_FINDINGS = "repo_id STRING, path STRING, line INT, message STRING, severity STRING"
ADVISORIES = (
    "ecosystem STRING, package STRING, versions ARRAY<STRING>, introduced STRING, fixed STRING, "
    "id STRING, summary STRING, details STRING, severity STRING"
)
VERDICTS = "repo_id STRING, file STRING, seq BIGINT, category STRING, covered BOOLEAN, reasoning STRING"
# Arguments stay JSON text: their types are free.
CALLS = (
    "call_ts TIMESTAMP, tool_name STRING, arguments STRING, description STRING, "
    "capabilities ARRAY<STRING>"
)
SCAN_RESULTS = "repo_key STRING, score STRING, scanned_at TIMESTAMP, seq BIGINT"
RULE_MATCH = (
    "STRUCT<tool_name: STRING, tool_name_contains: STRING, capability: STRING, "
    "arg_matches: MAP<STRING, STRING>, arg_value_contains: MAP<STRING, STRING>, "
    "description_contains: STRING, arguments_not_empty: ARRAY<STRING>>"
)
POLICY = (
    "version STRING, default_action STRING, rules ARRAY<STRUCT<name: STRING, "
    f"match: {RULE_MATCH}, match_type: STRING, action: STRING, reason: STRING, severity: STRING>>"
)
POLICY_RULES = (
    f"ARRAY<STRUCT<rule_ord: INT, name: STRING, match: {RULE_MATCH}, match_type: STRING, "
    "action: STRING, reason: STRING, severity: STRING>>"
)
ANALYZER_OUTPUT = (
    "results ARRAY<STRUCT<path: STRING, start: STRUCT<line: INT>, "
    "extra: STRUCT<message: STRING, severity: STRING>>>"
)

# What identifies one tool, and the order in which tools are listed in a repo.
TOOL_KEY = ["repo_id", "file", "seq"]
