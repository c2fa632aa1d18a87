"""The same results in SQL, for a second engine on the same tables.

Written from the rule tables for an RE2 engine; nothing here is used by the jobs.
"""

from __future__ import annotations

from toolguard import rules
from toolguard.guidance import GUIDANCE
from toolguard.queries import extended, seeds

W = r"\p{L}\p{N}_"
S = r"\t-\r\x1c-\x1f \x85\p{Z}"


# ------------------------------------------------------------------ SQL pieces
def q(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """RE2 form of a rule pattern; a word edge consumes one character or the end."""
    out, i, in_class = "", 0, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if two == r"\b":
            following = pattern[i + 2 : i + 3]
            out += f"(?:^|[^{W}])" if following.isalnum() else f"(?:[^{W}]|$)"
            i += 2
        elif two in (r"\w", r"\s"):
            body = W if two == r"\w" else S
            out += body if in_class else f"[{body}]"
            i += 2
        elif c == "\\":
            out += two
            i += 2
        else:
            in_class = (in_class or c == "[") and c != "]"
            out += r"[^\n]" if c == "." and not in_class else c
            i += 1
    return out


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(re2(pattern))})"


def any_of(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(has(text, p) for p in patterns) + ")"


def word(text: str, w: str) -> str:
    return f"regexp_matches({text}, {q(f'(?:^|[^{W}]){w}(?:[^{W}]|$)')})"


def contains_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def pick(key: str, choices: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE {key} % {len(choices)} {arms} END"


def fill(template: str | None, **values: str) -> str:
    if template is None:
        return "CAST(NULL AS VARCHAR)"
    text = q(template)
    for name, value in values.items():
        if "{" + name + "}" in template:
            text = f"replace({text}, '{{{name}}}', CAST({value} AS VARCHAR))"
    return text


def texts(key: str, templates: list, **values: str) -> str:
    return pick(key, [fill(t, **values) for t in templates])


def present(items: list[str]) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def joined(array: str) -> str:
    return f"array_to_string({array}, ',')"


def table_case(key: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {v if isinstance(v, int) else q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def flags(code: str, table: dict) -> str:
    return present([f"CASE WHEN {any_of(code, table[c])} THEN {q(c)} END" for c in rules.CATEGORIES])


def is_js(path: str) -> str:
    return f"regexp_matches(lower({path}), '\\.(js|ts|mjs|cjs|jsx|tsx)$')"


def both() -> dict:
    return {c: rules.PYTHON_BEHAVIOR[c] + rules.JS_BEHAVIOR[c] for c in rules.CATEGORIES}


# ----------------------------------------------------------------------- views
FILE = f"'src/f' || (k % {seeds.FILES}) || {texts('k', seeds.EXTENSIONS)}"
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


view("rows_v", """SELECT source AS repo_id, doc_id AS k, text FROM documents
UNION ALL SELECT CASE WHEN conv_id % 2 = 0 THEN 'chat_' || role ELSE 'chat-' || conv_id || '-' || turn END, conv_id * 100 + turn, text FROM conversations""")
view("tools_v", f"""SELECT repo_id, {FILE} AS file, CASE WHEN {is_js(FILE)} THEN 'JS/TS' ELSE 'Python' END AS language,
k AS seq, {texts('k', seeds.NAMES, k='k')} AS name,
{texts('k', seeds.PHRASES)} || ' ' || text AS description, {texts('k', seeds.SNIPPETS)} AS code_snippet FROM rows_v""")
OWN_FLAGS = f"CASE WHEN {is_js('file')} THEN {flags('code_snippet', rules.JS_BEHAVIOR)} ELSE {flags('code_snippet', rules.PYTHON_BEHAVIOR)} END"
view("own_v", f"SELECT *, {OWN_FLAGS} AS own FROM tools_v")
CATEGORY_LIST = "[" + ", ".join(q(c) for c in rules.CATEGORIES) + "]"
view("file_flags_v", f"""SELECT repo_id, file, list_filter({CATEGORY_LIST}, lambda c: list_contains(found, c)) AS flags
FROM (SELECT repo_id, file, list(DISTINCT flag) AS found FROM (SELECT repo_id, file, unnest(own) AS flag FROM own_v) GROUP BY ALL)""")
silent = {c: f"NOT {contains_any('lower(description)', rules.MENTION_WORDS[c])}" for c in rules.CATEGORIES}
mismatch = present([f"CASE WHEN list_contains(actual_behavior, {q(c)}) AND {silent[c]} THEN {q(c)} END" for c in rules.CATEGORIES])
view("behavior_v", f"""SELECT *, {mismatch} AS mismatches FROM (
SELECT o.*, CASE WHEN code_snippet IS NULL OR code_snippet = '' THEN coalesce(f.flags, []) ELSE own END AS actual_behavior,
coalesce(f.flags, []) AS file_flags FROM own_v o LEFT JOIN file_flags_v f USING (repo_id, file))""")
view("repos_v", """SELECT DISTINCT repo_id FROM (SELECT repo_id FROM rows_v UNION ALL SELECT 'part' || p_partkey FROM part
UNION ALL SELECT lower(n_name) FROM nation)""")

SEARCHABLE = "translate(lower(name || ' ' || description), '_-', '  ')"
view("searchable_v", f"SELECT *, {SEARCHABLE} AS txt FROM behavior_v")
keyword_arms = " ".join(
    f"WHEN {word('txt', w.replace('_', ' '))} THEN {q(w)}" for level in ("CRITICAL", "HIGH", "MEDIUM") for w in rules.RISK_WORDS[level]
)
level_of = {w: level for level in ("MEDIUM", "HIGH", "CRITICAL") for w in rules.RISK_WORDS[level]}
view("risk_v", f"""SELECT *, {table_case('risk_keyword', level_of, "'LOW'")} AS risk_level
FROM (SELECT *, CASE {keyword_arms} END AS risk_keyword FROM searchable_v)""")

# Descriptions.
phrase_arms = " ".join(f"WHEN {has('low', p)} THEN {i}" for i, (p, _, _) in enumerate(rules.INSTRUCTION_PHRASES))
matched_arms = " ".join(
    f"WHEN {i} THEN regexp_extract(low, {q(re2(p) if not p.startswith(chr(92) + 'b') else '(?:^|[^' + W + '])(' + re2(p.replace(chr(92) + 'b', '')) + ')(?:[^' + W + ']|$)')}, {1 if p.startswith(chr(92) + 'b') else 0})"
    for i, (p, _, _) in enumerate(rules.INSTRUCTION_PHRASES)
)
plain = {i: c for i, (_, c, _) in enumerate(rules.INSTRUCTION_PHRASES)}
text_of = {i: t for i, (_, _, t) in enumerate(rules.INSTRUCTION_PHRASES)}


def number_case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in table.items()) + " END"


view("phrase_v", f"""SELECT *, CASE {phrase_arms} END AS i, {any_of('low', rules.LEGITIMATE_FRAMING)} AS framed
FROM (SELECT *, lower(description) AS low FROM tools_v)""")
zero_arms = " ".join(f"WHEN contains(description, chr({ord(c)})) THEN {q(chr(39) + chr(92) + 'u%04x' % ord(c) + chr(39))}" for c in rules.ZERO_WIDTH)
before_n, after_n = rules.LONG_TEXT.split("{n}")
view("injection_v", f"""SELECT repo_id, file, seq, name AS tool, 'Suspicious instruction phrase' AS type, {number_case('i', text_of)} AS detail,
CASE WHEN framed THEN CASE {number_case('i', plain)} WHEN 'HIGH' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'LOW' ELSE 'LOW' END ELSE {number_case('i', plain)} END AS confidence,
{number_case('i', plain)} AS severity, CASE i {matched_arms} END AS matched_text FROM phrase_v WHERE i IS NOT NULL
UNION ALL SELECT repo_id, file, seq, name, 'Hidden characters', {q(rules.HIDDEN_TEXT)}, 'HIGH', 'HIGH', z
FROM (SELECT *, CASE {zero_arms} END AS z FROM tools_v) WHERE z IS NOT NULL
UNION ALL SELECT repo_id, file, seq, name, 'Unusually long description', {q(before_n)} || length(description) || {q(after_n)},
'MEDIUM', 'MEDIUM', 'length=' || length(description) FROM tools_v WHERE length(description) > {rules.LONG_DESCRIPTION}""")
redirect_arms = " ".join(f"WHEN {has('description', '(?i)' + p)} THEN {i}" for i, (p, _, _) in enumerate(rules.REDIRECT_PHRASES))


def redirect_group(group: int) -> str:
    return "CASE i " + " ".join(
        f"WHEN {i} THEN regexp_extract(description, {q('(?i)' + re2(p))}, {group})" for i, (p, _, _) in enumerate(rules.REDIRECT_PHRASES)
    ) + " END"


start_r, middle_r, end_r = rules.REDIRECT_TEXT.replace("{explanation}", "\0").replace("{referenced}", "\0").split("\0")
view("redirect_v", f"""SELECT repo_id, file, seq, name AS tool, 'Redirect language' AS type,
{q(start_r)} || {number_case('i', {i: t for i, (_, _, t) in enumerate(rules.REDIRECT_PHRASES)})} || {q(middle_r)} || target || {q(end_r)} AS detail,
{number_case('i', {i: c for i, (_, c, _) in enumerate(rules.REDIRECT_PHRASES)})} AS confidence, 'HIGH' AS severity, matched_text, target AS referenced_tool
FROM (SELECT *, {redirect_group(0)} AS matched_text, {redirect_group(1)} AS target
FROM (SELECT *, CASE {redirect_arms} END AS i FROM tools_v) WHERE i IS NOT NULL)""")
view("duplicate_v", """SELECT repo_id, name, CAST(count(*) AS BIGINT) AS registrations, count(DISTINCT file) AS files
FROM tools_v GROUP BY ALL HAVING count(*) > 1""")
view("by_name_v", """SELECT repo_id, name, registrations, redirects, CAST(CASE WHEN registrations > 1 THEN 1 ELSE 0 END + redirects AS BIGINT) AS shadowing_count
FROM (SELECT t.repo_id, t.name, count(*) AS registrations, count(r.seq) AS redirects
FROM tools_v t LEFT JOIN redirect_v r ON t.repo_id = r.repo_id AND t.file = r.file AND t.seq = r.seq GROUP BY ALL)
WHERE registrations > 1 OR redirects > 0""")
d_start, d_mid, d_end, d_tail = rules.DUPLICATE_TEXT.replace("{name}", "\0").replace("{n}", "\0").replace("{files}", "\0").split("\0")
view("duplicate_findings_v", f"""SELECT t.repo_id, t.name AS tool, 'Duplicate tool name' AS type,
{q(d_start)} || t.name || {q(d_mid)} || count(*) || {q(d_end)} ||
count(DISTINCT file) || ' files' || {q(d_tail)} AS detail,
'MEDIUM' AS confidence, 'HIGH' AS severity, count(*) || ' registrations across ' || count(DISTINCT file) || ' files' AS matched_text
FROM tools_v t GROUP BY t.repo_id, t.name HAVING count(*) > 1""")

# Permissions.
declared = present([f"CASE WHEN {contains_any('lower(description)', rules.DECLARE_WORDS[c])} THEN {q(c)} END" for c in rules.CATEGORIES])
view("sets_v", f"""SELECT *, {declared} AS declared,
CASE WHEN code_snippet IS NULL THEN file_flags ELSE {flags('code_snippet', both())} END AS actual FROM behavior_v""")
view("matrix_v", """SELECT *, CASE WHEN list_contains(undisclosed, 'subprocess_execution') OR list_contains(undisclosed, 'environment_access') THEN 'HIGH'
WHEN len(undisclosed) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS permission_severity
FROM (SELECT *, list_sort(list_filter(actual, lambda c: NOT list_contains(declared, c))) AS undisclosed,
list_sort(list_filter(declared, lambda c: NOT list_contains(actual, c))) AS extra FROM sets_v)""")
LAST = "row_number() OVER (PARTITION BY repo_id, name ORDER BY language ASC, file DESC, seq DESC)"
view("last_v", f"SELECT repo_id, name, permission_severity AS severity, list_sort(actual) AS actual, list_sort(declared) AS declared FROM (SELECT *, {LAST} AS n FROM matrix_v) WHERE n = 1")


# Blast radius.
def points(caps: str, table: dict) -> str:
    return " + ".join(f"CASE WHEN list_contains({caps}, {q(c)}) THEN {p} ELSE 0 END" for c, p in table.items())


def chain(caps: str, need: list[str]) -> str:
    return "(" + " AND ".join(f"list_contains({caps}, {q(c)})" for c in need) + ")"


def blast(caps: str, text: str, level: str) -> str:
    down = {c: level_ * len(t) for c, (level_, _, t) in rules.DOWNSTREAM.items()}
    chains = " + ".join(f"CASE WHEN {chain(caps, need)} THEN 5 ELSE 0 END" for _, need, _, _ in rules.CHAINS)
    tiers = " ".join(f"WHEN {' OR '.join(word(text, w) for w in tier)} THEN {p}" for p, tier in rules.IMPACT_WORDS)
    return f"""CAST({points(caps, rules.CAPABILITY_POINTS)} AS INTEGER) AS capability_amplification,
CAST(least({points(caps, down)}, 30) AS INTEGER) AS downstream_targets, CAST(least({chains}, 25) AS INTEGER) AS combination_paths,
CAST({table_case(level, rules.RISK_BASE_POINTS, '2')} + CASE {tiers} ELSE 0 END AS INTEGER) AS risk_amplification"""


SCORE = "CAST(least(capability_amplification + downstream_targets + combination_paths + risk_amplification, 100) AS INTEGER)"


def label(score: str) -> str:
    return f"CASE WHEN {score} >= 75 THEN 'CRITICAL' WHEN {score} >= 50 THEN 'HIGH' WHEN {score} >= 25 THEN 'MEDIUM' WHEN {score} > 0 THEN 'LOW' ELSE 'NONE' END"


COMPONENTS = "capability_amplification, downstream_targets, combination_paths, risk_amplification"
view("blast_v", f"SELECT *, {SCORE} AS blast_score, {label(SCORE)} AS blast_label FROM (SELECT *, {blast('actual_behavior', 'txt', 'risk_level')} FROM risk_v)")
NAME_TEXT = "translate(lower(name || ' '), '_-', '  ')"
view("radii_v", f"SELECT repo_id, name, {SCORE} AS score, {label(SCORE)} AS label, {COMPONENTS} FROM (SELECT *, {blast('actual', NAME_TEXT, 'severity')} FROM last_v)")

# Packages.
view("requirement_files_v", f"""SELECT 'part' || p_partkey AS repo_id,
{fill(seeds.REQUIREMENTS, package=texts('p_partkey', seeds.PACKAGES), size='p_size')} AS content FROM part""")
PIN = r"^([A-Za-z0-9_.\-]+)[" + S + r"]*==[" + S + r"]*([A-Za-z0-9_.\-]+)"
view("pins_v", f"""SELECT repo_id, CAST(line_no AS INTEGER) AS line_no, regexp_extract(line, {q(PIN)}, 1) AS package, regexp_extract(line, {q(PIN)}, 2) AS version
FROM (SELECT repo_id, line_no, trim(raw, ' ' || chr(13)) AS line FROM (SELECT repo_id, unnest(string_split(content, chr(10))) AS raw,
generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM requirement_files_v))
WHERE regexp_matches(line, {q(PIN)}) AND NOT starts_with(line, '#') AND NOT starts_with(line, '-')""")
trusted = ", ".join(f"({q(t)})" for t in rules.TRUSTED_PACKAGES)
view("squats_v", f"""SELECT repo_id, line_no, package, version, resembles, CAST(distance AS INTEGER) AS distance,
'''' || package || ''' closely resembles the well-known package ''' || resembles || ''' (edit distance ' || distance || ') - possible typosquatting.' AS reason
FROM (SELECT p.*, t.name AS resembles, levenshtein(lower(package), t.name) AS distance,
row_number() OVER (PARTITION BY repo_id, line_no ORDER BY levenshtein(lower(package), t.name), t.name) AS n
FROM pins_v p JOIN (VALUES {trusted}) t(name) ON levenshtein(lower(package), t.name) BETWEEN 1 AND CASE WHEN length(t.name) <= 4 THEN 1 ELSE 2 END
WHERE lower(package) NOT IN (SELECT name FROM (VALUES {trusted}) u(name))) WHERE n = 1""")


def version(v: str) -> str:
    return f"list_transform(string_split(regexp_replace({v}, '(\\.0+)+$', ''), '.'), lambda x: CAST(x AS BIGINT))"


view("advisories_v", f"""SELECT {texts('s_suppkey', seeds.ADVISED)} AS package, ['1.5.0', '2.0.' || s_nationkey] AS versions,
'1.' || s_nationkey AS introduced, CASE WHEN s_suppkey % 4 <> 0 THEN '1.' || (s_nationkey + 10) || '.0' END AS fixed,
'ADV-' || s_suppkey AS vuln_id, substring(coalesce(nullif(CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN s_name || ' allows remote code execution' END, ''),
CASE WHEN s_suppkey % 6 <> 5 THEN repeat(s_name || ' ', 15) END, {q(rules.NO_SUMMARY)}), 1, 200) AS summary,
{texts('s_suppkey', seeds.ADVISORY_SEVERITY)} AS severity FROM supplier""")
view("vulnerable_v", f"""SELECT p.package, p.version, p.repo_id, p.line_no, a.vuln_id, a.summary, a.severity FROM pins_v p JOIN advisories_v a ON p.package = a.package
AND (list_contains(a.versions, p.version) OR ({version('a.introduced')} <= {version('p.version')} AND (a.fixed IS NULL OR {version('p.version')} < {version('a.fixed')})))""")

# Secrets.
SECRET = re2(rules.SECRET_ASSIGNMENT)


def entropy(v: str) -> str:
    chars = f"string_split({v}, '')"
    return f"round(-list_sum(list_transform(list_distinct({chars}), lambda c: (len(list_filter({chars}, lambda x: x = c)) / length({v})) * log2(len(list_filter({chars}, lambda x: x = c)) / length({v})))), 6)"


def secrets(source: str, text: str, keep: str) -> str:
    return f"""SELECT {keep}, CAST(row_number() OVER (PARTITION BY {keep} ORDER BY kind, i) - 1 AS INTEGER) AS ord,
CASE kind WHEN 0 THEN 'AWS Access Key ID' ELSE 'High-entropy value' END AS type, substring(v, 1, 4) || '...' AS value_preview,
CASE WHEN kind = 0 OR bits >= 4.5 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
CASE kind WHEN 0 THEN 'matches a known key format' ELSE 'random-looking value in a secret-like name, bits per character: ' || CAST(round(bits, 2) AS VARCHAR) END AS reason
FROM (SELECT *, {entropy('v')} AS bits FROM (
SELECT {keep}, 0 AS kind, unnest(regexp_extract_all({text}, 'AKIA[0-9A-Z]{{16}}')) AS v, generate_subscripts(regexp_extract_all({text}, 'AKIA[0-9A-Z]{{16}}'), 1) AS i FROM {source}
UNION ALL SELECT {keep}, 1, unnest(regexp_extract_all({text}, {q(SECRET)}, 1)), generate_subscripts(regexp_extract_all({text}, {q(SECRET)}, 1), 1) FROM {source})
WHERE kind = 0 OR NOT regexp_full_match(v, 'AKIA[0-9A-Z]{{16}}')) WHERE kind = 0 OR bits >= 3.0"""


# Source files.
def code(kind: str, text: str) -> str:
    return fill(kind, lang="lang", text=text)


ESCAPED = "replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r')"
CLEANED = "translate(text, '\"''`(){}', '       ')"
KINDS = ["decorated", "decorated", "constructed", "script", "broken"]
view("kinds_v", f"""SELECT source AS repo_id, doc_id, lang, text, {pick('doc_id', [q(k) for k in KINDS])} AS kind,
{texts('doc_id', seeds.FOLDERS)} || 'm' || doc_id || CASE WHEN doc_id % 5 = 3 THEN '.ts' ELSE '.py' END AS path,
{ESCAPED} AS escaped, {CLEANED} AS cleaned FROM documents""")
view("files_v", f"""SELECT *, CASE kind WHEN 'decorated' THEN {code(seeds.PYTHON_DECORATED, 'escaped')} WHEN 'constructed' THEN {code(seeds.PYTHON_CONSTRUCTED, 'escaped')}
WHEN 'script' THEN {code(seeds.SCRIPT, 'cleaned')} ELSE {code(seeds.PYTHON_BROKEN, 'cleaned')} END AS content FROM kinds_v""")
SKIPPED_PY = ", ".join(q(d) for d in (*rules.PYTHON_PRUNED_DIRS, *rules.PYTHON_TEST_DIRS))
SKIPPED_JS = ", ".join(q(d) for d in {*rules.JS_PRUNED_DIRS, *rules.JS_SKIPPED_DIRS})
view("sources_v", f"""SELECT *, CASE WHEN kind = 'script' THEN 'JS/TS' ELSE 'Python' END AS language FROM files_v
WHERE CASE WHEN kind = 'script' THEN NOT list_has_any(string_split(lower(path), '/'), [{SKIPPED_JS}])
ELSE NOT list_has_any(string_split(lower(path), '/'), [{SKIPPED_PY}]) END""")


def stripped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{S}]+', ''), '[{S}]+$', '')"



def expected(kind: str) -> str:
    body = "cleaned" if kind in ("script", "broken") else "escaped"
    text = "cleaned" if kind in ("script", "broken") else "text"
    return " UNION ALL ".join(
        f"SELECT repo_id, path AS file, language, CAST({i} AS BIGINT) AS seq, {fill(name, lang='lang')} AS name, "
        f"{fill(description, strip=stripped(text))} AS description, {fill(snippet, lang='lang', text=body)} AS code_snippet, "
        f"{q(','.join(seeds.EXPECTED_FLAGS[kind]))} AS file_flags FROM sources_v WHERE kind = {q(kind)}"
        for i, (name, description, snippet) in enumerate(seeds.EXPECTED[kind])
    )


view("extracted_v", " UNION ALL ".join(expected(k) for k in seeds.EXPECTED))

# Calls and policy.
call_values = dict(k="user_id", props="props", value="value")
view("calls_v", f"""SELECT event_id, ts AS call_ts, coalesce({texts('event_id', seeds.CALL_TOOLS, type='event_type')}, 'unknown') AS tool_name,
event_id % {len(seeds.CALL_ARGUMENTS)} AS form, event_type, user_id, props, value,
{texts('event_id', [c for _, c, _ in seeds.CALL_ARGUMENTS], **call_values)} AS canonical_arguments,
{texts('event_id', [log or c for _, c, log in seeds.CALL_ARGUMENTS], **call_values)} AS logged_arguments,
{texts('event_id', seeds.CALL_DESCRIPTIONS)} AS description,
{pick('event_id', ['NULL' if c is None else '[' + ', '.join(q(x) for x in c) + ']' for c in seeds.CALL_CAPABILITIES])} AS capabilities FROM events""")


def can(category: str) -> str:
    return f"coalesce(list_contains(capabilities, {q(category)}), false)"


# Argument texts by form, written out from the seeds: command and path of form 0, url of form 2, and so on.
COMMAND = "CASE form WHEN 0 THEN 'rm  -rf /' ELSE '' END"
PATH = "CASE form WHEN 0 THEN '/' WHEN 3 THEN '/tmp/delete|remove|unlink|wipe' ELSE '' END"
URL = "CASE form WHEN 2 THEN 'http://0.0.0.0/x' ELSE '' END"
DEFAULT_CONDITIONS = [
    f"contains(lower(tool_name), 'delete') AND regexp_matches({COMMAND}, 'rm\\s+-rf') AND {PATH} = '/'",
    can("subprocess_execution"),
    can("environment_access"),
    f"({can('network_access')} OR contains({URL}, '0.0.0.0'))",
    f"contains({PATH}, 'delete|remove|unlink|wipe') AND {can('file_access')}",
]


def decided(conditions: list[tuple[str, dict]], default: str) -> str:
    def arms(field: str, missing: str) -> str:
        return " ".join(f"WHEN {c} THEN {q(r.get(field, missing))}" for c, r in conditions)

    severities = [(c, {**r, "severity": r.get("severity", "LOW") if r.get("severity", "LOW") in rules.POLICY_SEVERITIES else "LOW"}) for c, r in conditions]
    severity_arms = " ".join(f"WHEN {c} THEN {q(r['severity'])}" for c, r in severities)
    return f"""SELECT *, substring(sha256(tool_name || ':' || canonical_arguments), 1, 16) AS call_id,
CASE {arms('action', '')} ELSE {q(default)} END AS action, CASE {arms('name', '')} ELSE 'default_action' END AS rule,
CASE {arms('reason', '')} ELSE {q('No rule matched; using default action: ' + default)} END AS reason,
CASE {severity_arms} ELSE 'LOW' END AS severity FROM calls_v"""


view("decisions_v", decided(list(zip(DEFAULT_CONDITIONS, rules.DEFAULT_POLICY["rules"])), "ALLOW"))


def custom() -> str:
    from toolguard.queries.registry import CUSTOM_RULES

    own = [
        "lower(tool_name) = 'upload'",
        "(form = 5 OR contains(lower(tool_name), 'view') OR contains(lower(coalesce(description, '')), 'report'))",
        "false",
        "form = 8",
        "form = 6",
    ]
    kept = [p for p in zip(DEFAULT_CONDITIONS, rules.DEFAULT_POLICY["rules"]) if "subprocess" not in p[1]["name"]]
    added = {"name": "No scripts", "action": "BLOCK", "reason": "User-added rule: No scripts", "severity": "HIGH"}
    return decided([*zip(own, CUSTOM_RULES), *kept, ("contains(lower(tool_name), 'run_script')", added)], "LOG")


# Static findings, verdicts, report, gates.
view("static_v", f"""SELECT 'src' || (l_suppkey % 20) AS repo_id, 'src/f' || (l_partkey % 2000) || CASE WHEN l_linenumber % 2 = 0 THEN '.py' ELSE '.ts' END AS file,
count(*) AS static_findings, count(*) FILTER (l_returnflag IN ('A', 'R')) AS static_serious FROM lineitem GROUP BY ALL""")
view("injection_count_v", "SELECT repo_id, file, seq, CAST(count(*) AS INTEGER) AS injections, max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS worst_injection FROM injection_v GROUP BY ALL")


def report(source: str) -> str:
    return f"""SELECT r.repo_id, r.file, r.seq, r.name, r.language, r.description, r.actual_behavior, r.mismatches,
coalesce(s.static_findings, 0) AS static_findings, coalesce(s.static_serious, 0) AS static_serious, r.risk_level, r.risk_keyword,
coalesce(i.injections, 0) AS injections, i.worst_injection, coalesce(n.registrations, 1) AS registrations, coalesce(n.redirects, 0) AS redirects,
coalesce(n.shadowing_count, 0) AS shadowing_count, m.permission_severity, m.actual, r.blast_score, r.blast_label,
CASE WHEN i.injections > 0 OR n.shadowing_count > 0 OR s.static_serious > 0 OR r.risk_level = 'CRITICAL'
OR list_contains(r.mismatches, 'environment_access') OR list_contains(r.mismatches, 'subprocess_execution') THEN 'RED'
WHEN len(r.mismatches) > 0 OR s.static_findings > 0 OR r.risk_level IN ('HIGH', 'MEDIUM') THEN 'YELLOW' ELSE 'GREEN' END AS score
FROM {source} r LEFT JOIN static_v s USING (repo_id, file) LEFT JOIN injection_count_v i USING (repo_id, file, seq)
LEFT JOIN by_name_v n USING (repo_id, name) LEFT JOIN matrix_v m USING (repo_id, file, seq)"""


view("report_v", report("blast_v"))
view("verdicts_v", f"""SELECT source AS repo_id, {FILE} AS file, k AS seq, unnest(['file_access', 'network_access',
CASE WHEN k % 2 = 0 THEN 'environment_access' ELSE 'subprocess_execution' END]) AS category, quality = 1 AS covered,
'reviewed: quality ' || quality || ', toxic ' || toxic AS reasoning FROM (SELECT l.doc_id AS k, d.source, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))""")
view("covered_v", """SELECT repo_id, file, seq, list(DISTINCT category) AS covered FROM (SELECT repo_id, file, seq, unnest(mismatches) AS category FROM behavior_v) SEMI JOIN (FROM verdicts_v WHERE covered) USING (repo_id, file, seq, category) GROUP BY ALL""")
view("reviewed_v", """SELECT b.* REPLACE (list_filter(b.mismatches, lambda x: NOT list_contains(coalesce(c.covered, []), x)) AS mismatches)
FROM blast_v b LEFT JOIN covered_v c USING (repo_id, file, seq)""")
view("file_secrets_v", secrets("files_v", "content", "repo_id, path"))


def found(levels: dict) -> str:
    rank = rules.SEVERITY_RANK
    severity_rank = table_case("severity", {k: v for k, v in rank.items()}, "2")
    secret_rank = table_case("confidence", {k: v for k, v in rank.items()}, "0")
    shadow = "shadowing_count > 0" if rank["HIGH"] >= rank[levels["shadowing"]] else "false"
    return f"""SELECT repo_id, tools, red, yellow, failed_tools, secrets, failed_secrets, vulnerable, failed_dependencies, typosquats,
CASE WHEN secrets > 0 OR vulnerable > 0 OR typosquats > 0 OR red > 0 THEN 'RED' WHEN yellow > 0 THEN 'YELLOW' WHEN tools > 0 THEN 'GREEN' ELSE 'UNKNOWN' END AS overall
FROM (SELECT repo_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('tools', 'red', 'yellow', 'failed_tools', 'secrets', 'failed_secrets', 'vulnerable', 'failed_dependencies', 'typosquats'))} FROM repos_v
LEFT JOIN (SELECT repo_id, count(*) AS tools, count(*) FILTER (score = 'RED') AS red, count(*) FILTER (score = 'YELLOW') AS yellow,
count(*) FILTER ({table_case('score', {'RED': 4, 'YELLOW': 2}, '0')} >= {rank.get(levels['tool'], 0)} OR worst_injection >= {rank[levels['injection']]} OR {shadow}) AS failed_tools FROM report_v GROUP BY ALL) USING (repo_id)
LEFT JOIN (SELECT repo_id, count(*) AS secrets, count(*) FILTER ({secret_rank} >= {rank[levels['secret']]}) AS failed_secrets FROM file_secrets_v GROUP BY ALL) USING (repo_id)
LEFT JOIN (SELECT repo_id, count(*) AS vulnerable, count(*) FILTER (severe) AS failed_dependencies FROM (SELECT repo_id, line_no, bool_or({severity_rank} >= {rank[levels['dependency']]}) AS severe FROM vulnerable_v GROUP BY ALL) GROUP BY ALL) USING (repo_id)
LEFT JOIN (SELECT repo_id, count(*) AS typosquats FROM squats_v GROUP BY ALL) USING (repo_id))"""


def gate(levels: dict, source: str | None = None) -> str:
    rank = rules.SEVERITY_RANK
    overall = f"{table_case('overall', {'RED': 4, 'YELLOW': 2}, '0')} >= {rank[levels['overall']]}"
    typo = "true" if rank["MEDIUM"] >= rank[levels["typosquat"]] else "false"
    rows = [
        ("overall", "overall", f"CASE WHEN {overall} THEN 1 ELSE 0 END", f"NOT ({overall})"),
        ("secrets", "secret", "failed_secrets", "failed_secrets = 0"),
        ("dependencies", "dependency", "failed_dependencies", "failed_dependencies = 0"),
        ("typosquats", "typosquat", "typosquats", f"(typosquats = 0 OR NOT {typo})"),
        ("tools", "tool", "failed_tools", "failed_tools = 0"),
    ]
    return f"SELECT * FROM (WITH f AS ({source or found(levels)}) " + " UNION ALL ".join(
        f"SELECT repo_id, overall AS overall_score, {q(c)} AS category, {passed} AS passed, CAST({failed} AS BIGINT) AS failed_count, {q(levels[t])} AS threshold FROM f"
        for c, t, failed, passed in rows
    ) + ")"


def gate_failures(levels: dict) -> str:
    rank = rules.SEVERITY_RANK
    ranked = table_case("severity", dict(rank), "2")
    tool = (
        f"CASE WHEN {table_case('score', {'RED': 4, 'YELLOW': 2}, '0')} >= {rank.get(levels['tool'], 0)} THEN score "
        f"WHEN worst_injection > 0 AND worst_injection >= {rank[levels['injection']]} THEN {table_case('worst_injection', {v: k for k, v in rank.items() if k in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')})} "
        f"WHEN {'shadowing_count > 0' if rank['HIGH'] >= rank[levels['shadowing']] else 'false'} THEN 'HIGH' END"
    )
    squats = "true" if rank["MEDIUM"] >= rank[levels["typosquat"]] else "false"
    return f"""SELECT repo_id, 'secrets' AS category, path || ':' || ord || ':' || type AS item, confidence AS severity, {q(levels['secret'])} AS threshold FROM file_secrets_v
WHERE {table_case('confidence', dict(rank), '0')} >= {rank[levels['secret']]}
UNION ALL SELECT repo_id, 'dependencies', package || '==' || version, severity, {q(levels['dependency'])} FROM (SELECT repo_id, line_no, package, version,
arg_max(coalesce(severity, 'MEDIUM'), ({ranked}) * 1000 + ascii(coalesce(severity, 'MEDIUM'))) AS severity, max({ranked}) AS r FROM vulnerable_v GROUP BY ALL) WHERE r >= {rank[levels['dependency']]}
UNION ALL SELECT repo_id, 'typosquats', package, 'MEDIUM', {q(levels['typosquat'])} FROM squats_v WHERE {squats}
UNION ALL SELECT * FROM (SELECT repo_id, 'tools', file || ':' || seq || ':' || name, {tool} AS severity, {q(levels['tool'])} FROM report_v) WHERE severity IS NOT NULL"""


def repo_guidance() -> str:
    finding = {k: t for (kd, k), t in GUIDANCE.items() if kd == "finding"}
    impact, prevention = (table_case("about", {k: t[part] for k, t in finding.items()}) for part in (0, 1))
    return f"""SELECT repo_id, about, item, {impact} AS impact, {prevention} AS prevention FROM (SELECT repo_id, 'secret' AS about, path AS item FROM file_secrets_v
UNION ALL SELECT repo_id, 'dependency', vuln_id FROM vulnerable_v UNION ALL SELECT repo_id, 'typosquat', package FROM squats_v)"""


def guidance() -> str:
    def texts_of(kind: str, part: int) -> dict:
        return {k: t[part] for (kd, k), t in GUIDANCE.items() if kd == kind}

    return f"""SELECT repo_id, file, seq, about, {table_case('about', texts_of('capability', 0))} AS impact, {table_case('about', texts_of('capability', 1))} AS prevention
FROM (SELECT repo_id, file, seq, unnest(mismatches) AS about FROM behavior_v)
UNION ALL SELECT repo_id, file, seq, risk_level, NULL, {table_case('risk_level', texts_of('risk', 1))} FROM risk_v
UNION ALL SELECT repo_id, file, seq, about, {table_case('about', texts_of('finding', 0))}, {table_case('about', texts_of('finding', 1))}
FROM (SELECT repo_id, file, seq, 'injection' AS about FROM injection_count_v UNION ALL SELECT repo_id, file, seq, 'shadowing' FROM redirect_v)"""


# Scores and URLs.
KEY = "regexp_replace(regexp_replace(regexp_replace(lower(" + stripped("url") + "), '^https?://', ''), '/+$', ''), '\\.git$', '')"
view("scans_v", f"""SELECT {KEY} AS repo_key, score, scanned_at, seq FROM (SELECT {texts('o_orderkey', seeds.SCAN_URLS, k='o_custkey')} AS url,
{table_case('o_orderstatus', seeds.SCORE_BY_STATUS)} AS score, o_orderdate AS scanned_at, o_orderkey AS seq FROM orders)""")
view("latest_v", "SELECT repo_key, score, scanned_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY scanned_at DESC, seq DESC) AS n FROM scans_v) WHERE n = 1")
REPO = "^(https?://github\\.com/[\\p{L}\\p{N}_.-]+/[\\p{L}\\p{N}_.-]+?)(?:/(?:tree|blob)/.+)?(?:\\.git)?/?$"
view("urls_v", f"SELECT page_id, url AS raw, {stripped('url')} AS url FROM (SELECT page_id, {texts('page_id', seeds.URLS, k='page_id', url='url')} AS url FROM pages)")
view("full_urls_v", """SELECT *, CASE WHEN starts_with(url, 'git@github.com:') THEN 'https://github.com/' || substring(url, 16)
WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url WHEN starts_with(url, 'github.com/') THEN 'https://' || url
WHEN regexp_matches(url, '^[\\p{L}\\p{N}_.-]+/[\\p{L}\\p{N}_.-]+$') THEN 'https://github.com/' || url ELSE url END AS whole FROM urls_v""")
view("normal_urls_v", f"""SELECT *, CASE WHEN raw <> '' THEN CASE WHEN regexp_matches(whole, {q(REPO)})
THEN regexp_replace(regexp_extract(whole, {q(REPO)}, 1), '^http://', 'https://') ELSE whole END END AS normalized FROM full_urls_v""")


def width(text: str) -> str:
    return f"CAST(greatest(CAST(floor(length({text}) * 6.5) AS INTEGER) + 10, 20) AS INTEGER)"


# The corpus scan, from the expected extraction.
def corpus() -> dict[str, str]:
    """Views for the tools of the corpus, in place of those of ``tools_v``."""
    base = "SELECT repo_id, file, language, seq, name, description, code_snippet FROM extracted_v"
    flagged = "SELECT DISTINCT repo_id, file, CASE file_flags WHEN '' THEN [] ELSE string_split(file_flags, ',') END AS flags FROM extracted_v"
    hidden = "CASE WHEN NOT ends_with(file, '.py') OR NOT list_has_any(string_split(lower(file), '/'), ['.next', 'coverage']) THEN coalesce(f.flags, []) ELSE [] END"
    behavior = VIEWS["behavior_v"].replace("ELSE own END AS actual_behavior", "ELSE own END AS actual_behavior").replace(
        "OR code_snippet = '' THEN coalesce(f.flags, [])", f"OR code_snippet = '' THEN {hidden}"
    )
    return {"tools_v": base, "file_flags_v": flagged, "behavior_v": behavior}


def with_views(sql: str, replaced: dict[str, str] | None = None) -> str:
    """A statement with exactly the views that it needs, in order."""
    views = {**VIEWS, **(replaced or {})}
    needed, pending = set(), [sql]
    while pending:
        text = pending.pop()
        for name in views:
            if name in text and name not in needed:
                needed.add(name)
                pending.append(views[name])
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in views:
            if other != name and other in needed and other in views[name]:
                place(other)
        order.append(name)

    for name in views:
        if name in needed:
            place(name)
    clauses = ", ".join(f"{name} AS MATERIALIZED ({views[name]})" for name in order)
    return f"WITH {clauses} {sql}" if clauses else sql


# Patterns of rules, and what RE2 calls them ("$" there has no room for a line end).
FLAGGED = [
    (r"(?s)^c.*7\n*$", r"(?s)^c.*7\n*$"), (r"(?m)^view$", r"(?m)^view$"), (r"^purchase\n\d*[02468]$", r"^purchase\n[0-9]*[02468]$"),
    (r"(?m:^)1\d*$(?#end)", r"(?:^|\n)1[0-9]*$"), (r"^s.*9$", r"^s[^\n]*9$"), (r"(?:^|x)(?s:search.)5", r"(?s)(?:^|x)search.5"),
]


def statements() -> dict[str, str]:
    key = "repo_id, file, seq"
    risk_text = table_case("risk_level", rules.RISK_TEXT)
    found_default, lenient = found(rules.PRESETS["default"]), {**rules.PRESETS["lenient"], "overall": "YELLOW"}
    builds = "SELECT repo_id, overall_score, all_passed, build_fails, CASE WHEN NOT build_fails THEN 'none' WHEN legacy THEN 'overall score' ELSE 'category threshold' END AS failed_by, CAST(CASE WHEN build_fails THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM (SELECT repo_id, overall_score, bool_and(passed) AS all_passed, {legacy} AS legacy, {legacy} OR NOT bool_and(passed) AS build_fails FROM ({gate}) GROUP BY repo_id, overall_score)"
    paths = [
        (i, name, need, f"SELECT {key}, {i} AS p, {q(name)} AS path, {q(text)} AS description, {q(','.join(targets))} AS reaches, {q(','.join(need))} AS requires FROM blast_v WHERE {chain('actual_behavior', need)}")
        for i, (name, need, targets, text) in enumerate(rules.CHAINS)
    ]
    direct = [
        f"SELECT {key}, {10 + i} AS p, {q('Direct ' + c)} AS path, {q('Tool can ' + text)} AS description, {q(','.join(targets))} AS reaches, {q(c)} AS requires FROM blast_v WHERE list_contains(actual_behavior, {q(c)})"
        for i, (c, (_, text, targets)) in enumerate(rules.DOWNSTREAM.items())
    ]
    u_start, u_end = rules.UNDISCLOSED_TEXT.split("{what}")
    e_start, e_end = rules.INFLATED_TEXT.split("{what}")
    capability = table_case("category", rules.CAPABILITY_TEXT)
    report_columns = f"{key}, name, language, description, {joined('actual_behavior')} AS actual_behavior, {joined('mismatches')} AS mismatches, static_findings, static_serious, risk_level, risk_keyword, injections, registrations, redirects, shadowing_count, permission_severity, blast_score, blast_label, score"
    file_flags = f"CASE kind WHEN 'script' THEN {flags('content', rules.JS_BEHAVIOR)} ELSE {flags('content', rules.PYTHON_BEHAVIOR)} END"
    audit = "call_ts, call_id, action, rule, reason, severity, tool_name, logged_arguments"
    plain_queries = {
        "policy_decisions": "SELECT event_id, call_ts, tool_name, call_id, action, rule, reason, severity, logged_arguments FROM decisions_v",
        "policy_patterns": f"SELECT event_id, CASE WHEN rule IS NULL THEN 'ALLOW' ELSE 'BLOCK' END AS action, coalesce(rule, 'default_action') AS rule FROM (SELECT event_id, CASE {' '.join(f'WHEN regexp_matches(t, {q(r)}) THEN {q(p)}' for p, r in FLAGGED)} END AS rule FROM (SELECT event_id, lower(event_type) || chr(10) || user_id AS t FROM events))",
        "unreadable_calls": f"SELECT event_id, tool_name, 'BLOCK' AS action, 'unreadable_arguments' AS rule, 'The arguments are not a JSON object' AS reason, 'HIGH' AS severity, '{{}}' AS logged_arguments FROM calls_v WHERE event_id % 4 IN (1, 2) AND {pick('event_id', ['false' if a is None else 'true' for a, _, _ in seeds.CALL_ARGUMENTS])}",
        "policy_totals": "SELECT count(*) AS total_calls, count(*) FILTER (action = 'BLOCK') AS blocked, count(*) FILTER (action = 'REQUIRE_APPROVAL') AS require_approval, CAST(0 AS BIGINT) AS unreadable, CAST(CASE WHEN count(*) FILTER (action = 'BLOCK') > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM decisions_v",
        "policy_custom_rules": f"SELECT event_id, action, rule, reason, severity FROM ({custom()})",
        "policy_default_trail": "SELECT call_ts, tool_name, action, rule, call_id FROM decisions_v WHERE rule = 'default_action'",
        "call_ids": "SELECT event_id, canonical_arguments, call_id FROM decisions_v",
        "risk_levels": f"SELECT {key}, risk_level, risk_keyword, {risk_text} AS risk_explanation FROM risk_v",
        "injection_findings": "SELECT * FROM injection_v",
        "redirect_findings": "SELECT * FROM redirect_v",
        "duplicate_names": "SELECT * FROM duplicate_v",
        "duplicate_files": "SELECT repo_id, name, file, count(*) AS registrations FROM tools_v SEMI JOIN duplicate_v USING (repo_id, name) GROUP BY ALL",
        "shadowing_findings": "SELECT *, NULL AS referenced_tool FROM duplicate_findings_v UNION ALL SELECT repo_id, tool, type, detail, confidence, severity, matched_text, referenced_tool FROM redirect_v",
        "shadowing_by_name": "SELECT * FROM by_name_v",
        "snippet_flags": f"SELECT {key}, {joined(flags('c', rules.PYTHON_BEHAVIOR))} AS python_flags, {joined(flags('c', rules.JS_BEHAVIOR))} AS js_flags, {joined(flags('c', both()))} AS either_flags FROM (SELECT *, coalesce(code_snippet, '') AS c FROM tools_v)",
        "file_behavior": f"SELECT * FROM (SELECT repo_id, path, {joined(file_flags)} AS flags FROM sources_v WHERE kind = 'script' OR NOT list_has_any(string_split(lower(path), '/'), ['.next', 'coverage'])) WHERE flags <> ''",
        "tool_behavior": f"SELECT {key}, language, {joined('actual_behavior')} AS actual_behavior, {joined('mismatches')} AS mismatches, {joined('list_sort(list_distinct(list_transform(mismatches, lambda m: ' + table_case('m', rules.MISMATCH_SEVERITY) + ')))')} AS mismatch_severities FROM behavior_v",
        "declared_capabilities": f"SELECT {key}, {joined('declared')} AS declared FROM sets_v",
        "permission_matrix": f"SELECT {key}, {joined('list_sort(declared)')} AS declared, {joined('list_sort(actual)')} AS actual, {joined('undisclosed')} AS undisclosed_actual, {joined('extra')} AS extra_declared, {joined('CASE WHEN len(declared) = 0 AND len(actual) > 1 THEN list_sort(actual) ELSE [] END')} AS excessive, CAST(len(list_distinct(list_concat(actual, declared))) AS INTEGER) AS permission_count, len(undisclosed) > 0 AS has_undisclosed, len(extra) > 0 AS has_extra_declared, permission_severity FROM matrix_v",
        "permission_findings": f"SELECT {key}, name AS tool, 'Undisclosed capability' AS type, category, {table_case('category', rules.UNDISCLOSED_SEVERITY)} AS severity, {q(u_start)} || {capability} || {q(u_end)} AS detail FROM (SELECT *, unnest(undisclosed) AS category FROM matrix_v) UNION ALL SELECT {key}, name, 'Inflated declaration', category, 'LOW', {q(e_start)} || {capability} || {q(e_end)} FROM (SELECT *, unnest(extra) AS category FROM matrix_v)",
        "last_analysis_by_name": f"SELECT repo_id, name, severity, {joined('actual')} AS actual, {joined('declared')} AS declared FROM last_v",
        "blast_radius": f"SELECT {key}, blast_score AS score, blast_label AS label, {COMPONENTS} FROM blast_v",
        "attack_paths": f"SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY p) - 1 AS INTEGER) AS ord, path, description, reaches, requires FROM ({' UNION ALL '.join([p[3] for p in paths] + direct)})",
        "blast_by_name": f"SELECT repo_id, name, score, label, {COMPONENTS} FROM radii_v",
        "repo_blast_summary": f"SELECT repo_id, max_score, CASE WHEN total_tools = 0 THEN 'NONE' ELSE {label('max_score')} END AS max_label, total_tools, high_risk_tools FROM (SELECT repo_id, coalesce(max(score), 0) AS max_score, count(score) AS total_tools, count(*) FILTER (score >= 50) AS high_risk_tools FROM repos_v LEFT JOIN radii_v USING (repo_id) GROUP BY ALL)",
        "blast_ranking": "SELECT repo_id, name, score, label, rank() OVER (PARTITION BY repo_id ORDER BY score DESC) AS place FROM radii_v",
        "pinned_requirements": "SELECT * FROM pins_v",
        "first_requirements": "SELECT repo_id, line_no, package, version FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY line_no) AS n FROM pins_v) WHERE n <= 2",
        "typosquats": "SELECT * FROM squats_v",
        "vulnerable_packages": "SELECT * FROM vulnerable_v",
        "dependency_summary": "SELECT repo_id, repo_id IN (SELECT repo_id FROM requirement_files_v) AS requirements_found, coalesce(checked, 0) AS checked, coalesce(vulnerable_packages, 0) AS vulnerable_packages, coalesce(vulnerabilities, 0) AS vulnerabilities, CAST(0 AS BIGINT) AS skipped_unpinned FROM repos_v LEFT JOIN (SELECT repo_id, count(*) AS checked FROM pins_v GROUP BY ALL) USING (repo_id) LEFT JOIN (SELECT repo_id, count(DISTINCT line_no) AS vulnerable_packages, count(*) AS vulnerabilities FROM vulnerable_v GROUP BY ALL) USING (repo_id)",
        "secrets_in_documents": secrets("documents", "text", "doc_id"),
        "secrets_in_pages": secrets(f"(SELECT page_id, html || CASE WHEN page_id % 10 = 3 THEN {q(seeds.PAGE_SECRET)} || page_id || '''</script>' ELSE '' END AS html FROM pages)", "html", "page_id"),
        "calls_read_back": "SELECT tool_name, call_id, action, rule, logged_arguments FROM decisions_v",
        "policy_read_back": f"SELECT event_id, action, rule, reason, severity FROM ({custom()})",
        "report_read_back": "SELECT repo_id, file, seq, risk_level, score FROM report_v",
        "analyzer_findings": """SELECT 'repo' AS repo_id, file, count(*) AS static_findings, count(*) FILTER (n % 3 <> 0) AS static_serious FROM (SELECT n,
CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '../' ELSE '/scan/other/' END || CASE WHEN n % 5 <> 4 THEN 'f' || p || '.py' ELSE 'x/y.py' END AS file
FROM (SELECT l_linenumber AS n, l_partkey % 50 AS p FROM lineitem)) WHERE NOT starts_with(file, '../') GROUP BY ALL""",
        "source_trees": "SELECT 'source=' || source AS repo_id, CAST(sum(length(text) + 1) AS BIGINT) AS characters FROM documents GROUP BY ALL",
        "secrets_in_files": "SELECT * RENAME (path AS file) FROM file_secrets_v",
        "repository_urls": f"SELECT page_id, normalized, coalesce(regexp_matches(normalized, '^https://github\\.com/[\\p{{L}}\\p{{N}}_.-]+/[\\p{{L}}\\p{{N}}_.-]+(?:\\.git)?/?$'), false) AS valid, {KEY} AS repo_key FROM normal_urls_v",
        "latest_scores": "SELECT * FROM latest_v",
        "score_lookup": "SELECT c_custkey, 'github.com/org/repo' || c_custkey AS repo_key, coalesce(score, 'UNKNOWN') AS score, scanned_at FROM customer LEFT JOIN latest_v ON repo_key = 'github.com/org/repo' || c_custkey",
        "badges": f"SELECT repo_key, score, message, color, {width(q('tool security'))} AS label_width, {width('message')} AS message_width, CAST({width(q('tool security'))} + {width('message')} AS INTEGER) AS total_width FROM (SELECT *, {table_case('score', rules.BADGE_LABELS, q('unknown'))} AS message, {table_case('score', rules.BADGE_COLORS, q('#9f9f9f'))} AS color FROM latest_v)",
        "static_findings_by_tool_file": f"SELECT repo_id, file, CAST(l_linenumber AS VARCHAR) AS line, 'ships ' || l_linestatus AS message, coalesce({table_case('l_returnflag', seeds.STATIC_SEVERITY)}, 'INFO') AS severity FROM (SELECT *, 'src' || (l_suppkey % 20) AS repo_id, 'src/f' || (l_partkey % 2000) || CASE WHEN l_linenumber % 2 = 0 THEN '.py' ELSE '.ts' END AS file FROM lineitem) SEMI JOIN tools_v USING (repo_id, file)",
        "gate_failures": gate_failures(rules.PRESETS["default"]),
        "repo_guidance": repo_guidance(),
        "static_findings_by_file": "SELECT * FROM static_v",
        "tool_report": f"SELECT {report_columns} FROM report_v",
        "reviewed_mismatches": f"SELECT {key}, {joined('mismatches')} AS mismatches, score FROM ({report('reviewed_v')})",
        "finding_guidance": guidance(),
        "scan_counts": "SELECT repo_id, count(*) AS tools, count(*) FILTER (score = 'RED') AS red, count(*) FILTER (score = 'YELLOW') AS yellow, count(*) FILTER (score = 'GREEN') AS green FROM report_v GROUP BY ALL",
        "overall_scores": found_default,
        "gate_default": gate(rules.PRESETS["default"]),
        "gate_strict": gate(rules.PRESETS["strict"]),
        "gate_lenient": gate(rules.PRESETS["lenient"]),
        "build_decisions": builds.format(legacy="overall_score IN ('RED', 'YELLOW')", gate=gate(lenient)),
        "tool_source_files": "SELECT repo_id, path, language FROM sources_v",
        "review_notes": "SELECT repo_id, file, seq, category, covered, reasoning FROM (SELECT repo_id, file, seq, unnest(mismatches) AS category FROM behavior_v) JOIN verdicts_v USING (repo_id, file, seq, category)",
        "language_counts": "SELECT repo_id, count(*) FILTER (language = 'Python') AS python_files, count(*) FILTER (language = 'JS/TS') AS js_files FROM sources_v GROUP BY ALL",
        "budget_warnings": "SELECT *, CASE WHEN capped THEN 'This repo has more than 7 files in one language - only the first 7 of that language were scanned for tools, and static analysis was skipped entirely.' WHEN too_large THEN 'This repo has more than 9 Python + JS/TS files combined, so static analysis was skipped (tools were still scanned across up to 7 files per language).' END AS warning FROM (SELECT *, python_files > 7 OR js_files > 7 AS capped, python_files + js_files > 9 AS too_large FROM (SELECT repo_id, count(*) FILTER (language = 'Python') AS python_files, count(*) FILTER (language = 'JS/TS') AS js_files FROM sources_v GROUP BY ALL))",
        "files_within_budget": "SELECT repo_id, path, language FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, language ORDER BY path) AS n FROM sources_v) WHERE n <= 7",
        "extracted_tools": "SELECT * FROM extracted_v",
        "stream_decisions": f"SELECT {audit} FROM decisions_v",
        "stream_action_counts": "SELECT time_bucket(INTERVAL 1 HOUR, call_ts) AS window_start, time_bucket(INTERVAL 1 HOUR, call_ts) + INTERVAL 1 HOUR AS window_end, action, count(*) AS calls FROM decisions_v GROUP BY ALL",
        "stream_latest_scores": "SELECT * FROM latest_v",
    }
    gates = [f"SELECT {q(name)} AS preset, * FROM ({gate(levels)})" for name, levels in extended.PRESETS.items()]
    plain_queries |= {**extended.SQL, "gates_of_all_presets": " UNION ALL ".join(gates)}
    corpus_queries = {
        "corpus_report": f"SELECT {key}, name, language, {joined('actual_behavior')} AS actual_behavior, {joined('mismatches')} AS mismatches, risk_level, {joined('list_sort(actual)')} AS actual, permission_severity, shadowing_count, blast_score, score FROM report_v",
        "corpus_builds": builds.format(legacy="overall_score = 'RED'", gate=gate(rules.PRESETS["default"])),
    }
    corpus_views = {**corpus(), "repos_v": "SELECT DISTINCT repo_id FROM (SELECT repo_id FROM files_v UNION ALL SELECT repo_id FROM requirement_files_v)"}
    return {
        **{name: with_views(sql) for name, sql in plain_queries.items()},
        **{name: with_views(sql, corpus_views) for name, sql in corpus_queries.items()},
    }
