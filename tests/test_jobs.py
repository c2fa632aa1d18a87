"""Files, extraction, joins, gates, streams and the whole scan, on small corpora."""

import json

import pytest
from pyspark.sql import functions as F

from toolguard import rules, scale, schemas
from toolguard.functions import js_tools, python_tools
from toolguard.operators import attach, extraction, gate, history, policy, shadowing
from toolguard.plans import scan
from toolguard.sources import files, requirements, tables
from toolguard.streaming import calls as call_streams
from toolguard.streaming import scans as scan_streams

SERVER = '''
import httpx

ATLAS = Tool(name="open_atlas", description="Opens an atlas file", handler=draw)
PIGEON = Tool("carrier_pigeon", "Will send mail, slowly")

@harbour.tool()
def tides(port):
    """Gets tides of a port over http."""
    return httpx.get(TIDES + port).json()
'''
EVIL = '''
KEYS = Tool(name="ring_bell", description="Rings the bell")

@harbour.tool()
def feed_cat(bowl):
    """Feeds the cat."""
    return subprocess.run(["dispense", bowl])
'''


def corpus(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.SOURCE_FILES)


# ------------------------------------------------------------------ extraction
def test_python_variants():
    # What marks a tool, where its name and text come from, and what marks none, one case after another.
    cases = [
        ("@quay.tool\nasync def moor(ship):\n    'Ties up\\n  a ship.'", ("moor", "Ties up\na ship.")),  # cleaned as docstrings are
        ("@noted\n@quay.tool(description='Lifts', name='crane_7')\n@noted(name='crane_8')\ndef lift(): ...", ("crane_8", "Lifts")),
        ("@router.delete('/buoys')\ndef drop_buoy(): ...", ("drop_buoy", "No description found")),
        ("@tool\ndef whistle(): ...", ("whistle", "No description found")),
        ("class Bells(str, Enum):\n    FOG = 'fog_bell'\n\nb = quay.Tool(description='Rings', name=Bells.FOG)", ("fog_bell", "Rings")),
        ("ropes = [Tool('knot', 'Ties knots')]", ("knot", "Ties knots")),
        ("anchor = Tool(description='Holds')", ("UNKNOWN", "Holds")),
        ("class Bells(Enum):\n    FOG = 'fog_bell'\n\nb = Tool(name=Bells.HORN)", None),
        ("@router.trace('/x')\ndef traced(): ...", None),
        ("def rowing(boat):\n    'No tool.'", None),
    ]
    for code, want in cases:
        assert [(n, d) for n, d, _ in python_tools.tools_in(code)] == ([want] if want else []), code
    several = "\n\n".join(code for code, want in cases if want)
    assert {(n, d) for n, d, _ in python_tools.tools_in(several)} == {want for _, want in cases if want}


def test_snippets_with_wide_characters():
    code = 'é = 1\nclass A:\n    @mcp.tool\n    def f(self):\n        return "ü" + open("é")\n\nx = ["é", Tool("n", "ü")]\n'
    snippets = {n: s for n, _, s in python_tools.tools_in(code)}
    assert snippets == {"f": 'def f(self):\n        return "ü" + open("é")', "n": 'Tool("n", "ü")'}


def test_files_that_do_not_parse():
    code = '''
class Names(Enum):
    READ = "read_it"

T = [
    Tool(name=Names.READ.value, description="""Long
text"""),
    Tool(name="both", description="short"),
    Tool(other=1),
]

@mcp.tool(description="given")
def both(x): return x

@app.post("/y")
async def second(x) -> dict:
    return open(x)

print "old"
'''
    assert python_tools.tools_in(code) == [
        ("read_it", "Long\ntext", None), ("both", "short", None),
        ("second", "No description found", "def second(x) -> dict:\n    return open(x)\n"),
    ]


def test_large_python_file():
    harbours = "".join(f"DEPTH_{i} = {{'low': {i}, 'high': {i + 3}}}\n" for i in range(5000))
    pilots = "".join(f"@quay.tool\ndef pilot_{i}(ship):\n    '''Guides ship {i} {'in and out ' * 300}'''\n\n" for i in range(40))
    found = python_tools.tools_in(harbours + pilots + harbours)
    assert [n for n, _, _ in found] == [f"pilot_{i}" for i in range(40)]
    assert all(d == f"Guides ship {i} {'in and out ' * 300}".strip() for i, (_, d, _) in enumerate(found))


def test_js_variants():
    body = "const x = 1;\n" * 500
    code = f'''
server.tool("large", "Detailed text", {{}}, async () => {{ {body} return {{ content: [] }}; }});
server.registerTool({{ name: "registered", description: "Options object" }}, async () => {{}});
server.addTool(`named`, {{ description: 'inside' }});
const list = [{{ description: "First", name: "literal" }}, {{ name: "string", description: "a type" }}, {{ name: "large", description: "again" }}];
'''
    found = {n: (d, s) for n, d, s in js_tools.tools_in(code)}
    assert {n: d for n, (d, _) in found.items()} == {
        "large": "Detailed text", "registered": "Options object", "named": "inside", "literal": "First",
    }
    assert found["large"][1].endswith("})") and len(found["large"][1]) > 6000


def test_long_js_registration_is_whole():
    code = 'server.tool("long", "Does much", async () => {\n' + "const x = 1;\n" * 20_000 + 'child_process.exec("ls");\n});\n'
    ((name, _, snippet),) = js_tools.tools_in(code)
    assert name == "long" and len(snippet) > 250_000 and "child_process" in snippet
    # Calls that never close end with the file.
    assert [len(s) for _, _, s in js_tools.tools_in('a.tool("x", "y", (\n' * 3)][:1] == [3 * 19 - 1]


def test_copies_are_parsed_once_and_all_reported(spark):
    given = corpus(
        spark, *[(f"r{i}", f"p{i}.py", EVIL) for i in range(20)], ("r0", "tests/x.py", EVIL), ("r0", "a.ts", "none"),
        ("r0", "empty.py", ""),
    )
    found = extraction.extract_tools(files.tool_sources(given))
    assert sorted((r.repo_id, r.file, r.seq, r.name) for r in found.collect()) == sorted(
        (f"r{i}", f"p{i}.py", s, n) for i in range(20) for s, n in enumerate(["feed_cat", "ring_bell"])
    )
    assert found.first().file_flags == ["subprocess_execution"]


def test_the_corpus_is_read_once(spark, tmp_path):
    given = corpus(spark, *[(f"r{i}", "a.py", EVIL) for i in range(50)], ("r0", "requirements.txt", "flask==1.0\n"))
    given.repartition(3).write.parquet(str(tmp_path / "files"))
    stored = spark.read.parquet(str(tmp_path / "files"))
    plan = extraction.with_tools(stored.select("repo_id", F.lit("Python").alias("language"), "content"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Sort" not in plan
    scanned = scan.scan_files(stored)
    assert "content" not in scanned.columns and scanned.count() == 51
    found = scan.scan_corpus(stored, spark.createDataFrame([], schemas.ADVISORIES), spark.createDataFrame([], schemas.STATIC_FINDINGS))
    for part in (found.repos, found.tools, found.secrets, found.requirements, found.vulnerable, found.typosquats, found.languages, found.report):
        assert str(tmp_path) not in part._jdf.queryExecution().executedPlan().toString()
    assert (found.tools.count(), found.repos.count(), found.requirements.count()) == (100, 50, 1)


# ------------------------------------------------------------------------ files
@pytest.mark.parametrize(
    "path, python, js",
    [
        ("a.py", True, False), ("src/test_a.py", False, False), ("src/a_test.py", False, False), ("conftest.py", False, False),
        ("Tests/a.py", False, False), ("vendor/a.py", False, False), ("coverage/a.py", True, False), ("a.PY", False, False),
        ("a.ts", False, True), ("vendor/a.ts", False, True), ("dist/a.js", False, False), ("a.d.ts", False, False),
        ("a.spec.tsx", False, True), ("a.test.js", False, False), ("__tests__/a.mjs", False, False), ("x/.next/a.cjs", False, False),
    ],
)
def test_file_choice(spark, path, python, js):
    row = spark.createDataFrame([(path,)], "p string").select(files.is_python_source(F.col("p")), files.is_js_source(F.col("p")))
    assert row.collect()[0] == (python, js)


def test_reading_files(spark, tmp_path):
    (tmp_path / "repo one" / "src").mkdir(parents=True)
    (tmp_path / "repo one" / "src" / "a%20b.py").write_bytes(b"x = '\xff\xe9'\r\ny\rz\xc3\xa9")
    (tmp_path / "repo one" / "requirements.txt").write_text("flask==2.0\n")
    (tmp_path / "repo one" / "data.bin").write_bytes(b"\x00")
    found = {(r.repo_id, r.path): r.content for r in files.read_source_files(spark, str(tmp_path)).collect()}
    assert found == {("repo one", "src/a%20b.py"): "x = ''\ny\nzé", ("repo one", "requirements.txt"): "flask==2.0\n"}


def test_budget_keeps_the_first_files(spark):
    given = corpus(spark, *[("r", f"f{i:03d}.py", "") for i in range(50)], ("r", "z.ts", ""), ("s", "z.py", ""))
    kept = files.within_budget(files.tool_sources(given), limit=5).collect()
    assert sorted(r.path for r in kept if r.repo_id == "r" and r.language == "Python") == [f"f{i:03d}.py" for i in range(5)]
    assert len(kept) == 7
    counts = files.language_counts(files.tool_sources(given))
    warned = {r.repo_id: r for r in files.budget_warnings(counts, limit=5, analysis=100).collect()}
    assert (warned["r"].python_files, warned["r"].js_files, warned["r"].capped) == (50, 1, True)
    assert warned["s"].warning is None


def test_requirement_lines(spark):
    text = "# c\n\nflask==2.0.0\r\n  Requests == 2.28.0 ; extra\n-e x==1\nnumpy>=1\x0btorch==1\u2028a-b.c==1_0\n"
    found = requirements.parse_requirements(corpus(spark, ("r", "requirements.txt", text))).collect()
    assert [(r.line_no, r.package, r.version) for r in found] == [
        (3, "flask", "2.0.0"), (4, "Requests", "2.28.0"), (7, "torch", "1"), (8, "a-b.c", "1_0"),
    ]
    assert requirements.parse_requirements(corpus(spark, ("r", "requirements.txt", text)), first=1).count() == 1


def test_static_analyzer_output(spark, tmp_path):
    (tmp_path / "out.json").write_text(
        json.dumps({"results": [{"path": "./a//b.py", "start": {"line": 3}, "extra": {"message": "m", "severity": "ERROR"}}, {"path": "a/b.py"}, {"path": ""}]})
    )
    found = tables.read_static_findings(spark, str(tmp_path / "out.json"), "r")
    assert sorted(tuple(r) for r in found.collect()) == [("r", "./a//b.py", 3, "m", "ERROR"), ("r", "a/b.py", None, "No message", "INFO")]
    assert [tuple(r) for r in attach.static_by_file(found).collect()] == [("r", "a/b.py", 2, 1)]


@pytest.mark.parametrize(
    "path, file",
    [
        ("a.py", "a.py"), ("./a//b.py", "a/b.py"), ("a/../b.py", "b.py"), ("../x.py", "../x.py"), ("a/../../x.py", "../x.py"), ("/a/./b.py", "/a/b.py"),
        ("/../b.py", "/b.py"), ("/work/repo/src/a.py", "src/a.py"), ("/work/repo/../x.py", "/work/x.py"), ("/work/repository/a.py", "/work/repository/a.py"),
        ("..", ".."), ("a\\b.py", "a/b.py"),
    ],
)
def test_paths(spark, path, file):
    row = spark.createDataFrame([(path,)], "p string").select(attach.normalized_path(F.col("p"), "/work/./repo/").alias("f")).first()
    assert row.f == file


def test_findings_outside_a_repo_concern_no_file(spark):
    rows = [("r", p, 3, "m", "ERROR") for p in ("../x.py", "x.py", "/repo/x.py", "a/../../x.py")] + [("r", "x.py", None, None, None)]
    found = spark.createDataFrame(rows, schemas.STATIC_FINDINGS)
    assert [tuple(r) for r in attach.static_by_file(found, "/repo").collect()] == [("r", "x.py", 3, 2)]
    assert [tuple(r) for r in attach.static_outside(found).collect()] == [("r", 2)]
    tools = spark.createDataFrame([("r", "./x.py", "Python", 0, "n", "d", None)] * 2, schemas.TOOLS)
    in_files = attach.static_in_tool_files(found, tools, "/repo").collect()
    assert sorted(tuple(r)[2:] for r in in_files) == [("3", "m", "ERROR")] * 2 + [("?", "No message", "INFO")]


def test_behavior_of_scanned_files_only(spark):
    code = "import subprocess\nsubprocess.run(x)\n"
    paths = ["a.py", "tests/a.py", "node_modules/a.py", "coverage/a.py", "test_a.py", "vendor/a.ts", "dist/a.ts", "a.spec.ts"]
    found = attach.file_behavior(corpus(spark, *[("r", p, code if p.endswith("py") else "fetch('x')") for p in paths]))
    assert sorted(r.path for r in found.collect()) == ["a.py", "vendor/a.ts"]


# ------------------------------------------------------------------------ scale
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_join(spark, how):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(0, "hot"), (0, "twice"), (3, "cold"), (5, "none")], "k long, v string")
    hot = scale.hot_keys(left, ["k"], floor=100)
    assert [r.k for r in hot.collect()] == [0]
    salted = scale.salted_join(left, right, ["k"], how, spread=["x"], hot=hot, salts=8)
    plain = left.join(right, ["k"], how)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_first_per_group_equals_ranking(spark):
    rows = spark.range(5000).select((F.col("id") % 7 == 0).alias("g"), ((F.col("id") * 37) % 5000).alias("x"))
    found = scale.first_per_group(rows, ["g"], ["x"], 10, salts=4).collect()
    data = [(r.g, r.x) for r in rows.collect()]
    assert sorted((r.g, r.x) for r in found) == sorted(
        (g, x) for g in (False, True) for x in sorted(x for h, x in data if h == g)[:10]
    )


def test_hot_names_give_whole_results(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_FLOOR", 20)
    rows = [("r", f"f{i % 30}.py", "Python", i, "same" if i % 3 else f"n{i}", "instead of x" if i % 2 else "d", None) for i in range(600)]
    given = spark.createDataFrame(rows, schemas.TOOLS)
    joined = attach.attach_shadowing(given, shadowing.shadowing_by_name(given)).collect()
    same = [r for r in joined if r.name == "same"]
    assert len(joined) == 600 and {r.shadowing_count for r in same} == {1 + sum(r[4] == "same" and r[5] != "d" for r in rows)}
    assert shadowing.duplicate_files(given).count() == len({r[1] for r in rows if r[4] == "same"})


# ------------------------------------------------------------------------ gates
def test_verdicts_reach_every_mismatch(spark):
    given = spark.createDataFrame(
        [("r", "a.py", "Python", i, ["file_access", "network_access"]) for i in range(60)],
        "repo_id string, file string, language string, seq bigint, mismatches array<string>",
    )
    verdicts = spark.createDataFrame(
        [("r", "a.py", i, c, c == "network_access", f"note {i}") for i in range(60) for c in ("network_access", "file_access", "other")], schemas.VERDICTS
    )
    assert {tuple(r.mismatches) for r in attach.confirmed_mismatches(given, verdicts).collect()} == {("file_access",)}
    notes = attach.review_notes(given, verdicts).collect()
    assert len(notes) == 120 and {(r.seq, r.reasoning) for r in notes} == {(i, f"note {i}") for i in range(60)}


def test_duplicates_of_any_number_have_one_form(spark):
    rows = [("r", f"f{i}.py", "Python", i, "one" if i else "two", "d", None) for i in range(150)] + [("r", "g.py", "Python", 0, "two", "d", None)]
    given = spark.createDataFrame(rows, schemas.TOOLS)
    found = {r.tool: r.matched_text for r in shadowing.duplicate_findings(given).collect()}
    assert found == {"one": "149 registrations across 149 files", "two": "2 registrations across 2 files"}
    assert shadowing.duplicate_files(given).count() == 151


def found_row(spark, **counts):
    names = ["tools", "red", "yellow", "failed_tools", "secrets", "failed_secrets", "vulnerable", "failed_dependencies", "typosquats"]
    row = spark.createDataFrame([("r", *[counts.get(n, 0) for n in names])], ", ".join(["repo_id string", *[f"{n} bigint" for n in names]]))
    return row.withColumn("overall", gate.overall_score())


@pytest.mark.parametrize(
    "counts, overall", [({}, "UNKNOWN"), ({"tools": 1}, "GREEN"), ({"tools": 2, "yellow": 1}, "YELLOW"), ({"typosquats": 1}, "RED")]
)
def test_overall(spark, counts, overall):
    assert found_row(spark, **counts).first().overall == overall


def test_gate_categories(spark):
    found = found_row(spark, tools=1, yellow=1, failed_tools=1, typosquats=2)
    passed = {r.category: r.passed for r in gate.evaluate(found, {"overall": "RED", "typosquat": "HIGH"}).collect()}
    assert passed == {"overall": False, "secrets": True, "dependencies": True, "typosquats": True, "tools": False}
    # A threshold of rank 0 is met by everything.
    (overall,) = gate.evaluate(found_row(spark), {"overall": "NEVER"}).where("category = 'overall'").collect()
    assert not overall.passed


@pytest.mark.parametrize("fail_on, fails", [("RED", False), ("YELLOW", True), ("NEVER", False)])
def test_build_decision(spark, fail_on, fails):
    found = found_row(spark, tools=1, yellow=1)
    decided = gate.decisions(gate.evaluate(found, {"overall": fail_on}), fail_on).first()
    assert (decided.build_fails, decided.exit_code) == (fails, int(fails))


# --------------------------------------------------------------- the whole scan
def test_scan_of_a_small_corpus(spark, tmp_path):
    given = corpus(
        spark, ("a", "server.py", SERVER), ("a", "evil_tool.py", EVIL), ("a", "requirements.txt", "flask==2.0.0\nreqeusts==2.28.0\n"),
        ("b", "README.md", "nothing"), ("c", "ok.py", '@mcp.tool\ndef ping():\n    """Says hello."""\n    return 1\n'),
    )
    advisories = spark.createDataFrame([("PyPI", "flask", ["2.0.0"], None, None, "X", "bad", None, "HIGH")], schemas.ADVISORIES)
    static = spark.createDataFrame([("a", "./server.py", 1, "m", "WARNING")], schemas.STATIC_FINDINGS)
    result = scan.scan_corpus(given, advisories, static)
    report = {r.name: r for r in result.report.collect()}
    assert set(report) == {"tides", "open_atlas", "carrier_pigeon", "feed_cat", "ring_bell", "ping"}
    assert report["feed_cat"].mismatches == ["subprocess_execution"] and report["feed_cat"].score == "RED"
    assert report["ping"].score == "GREEN" and report["tides"].static_serious == 1
    assert report["feed_cat"].mismatch_impacts[0].impact and report["ping"].injection_impact is None
    builds = {r.repo_id: (r.overall_score, r.exit_code) for r in result.builds(rules.PRESETS["default"]).collect()}
    assert builds == {"a": ("RED", 1), "b": ("UNKNOWN", 0), "c": ("GREEN", 0)}
    tables.write_report(result.report, str(tmp_path / "report"), "json", buckets=4)
    assert spark.read.json(str(tmp_path / "report")).count() == 6


# ---------------------------------------------------------------------- streams
def test_decisions_stream_in_batches(spark, tmp_path):
    source = tmp_path / "calls"
    source.mkdir()
    out, log = str(tmp_path / "audit"), str(tmp_path / "log")
    for n in range(2):
        rows = [{"tool_name": f"t{n}{i}", "call_ts": f"2024-01-0{n + 1}T00:00:00", "capabilities": ["network_access"] * i} for i in range(2)]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = tables.stream_calls(spark, str(source), files_per_batch=1)
        call_streams.decide_stream(stream, policy.default_policy(), out, log).trigger(availableNow=True).start().awaitTermination()
    found = tables.read_audit(spark, out).collect()
    assert sorted((r.tool_name, r.action) for r in found) == [("t00", "ALLOW"), ("t01", "BLOCK"), ("t10", "ALLOW"), ("t11", "BLOCK")]


def test_late_calls_are_dropped(spark, tmp_path):
    source = tmp_path / "calls"
    source.mkdir()
    out, log = str(tmp_path / "counts"), str(tmp_path / "log")
    for n, times in enumerate([["00:10", "01:20"], ["05:00"], ["00:20", "05:30"], ["09:00"]]):
        rows = [{"tool_name": "t", "call_ts": f"2024-01-01T{t}:00"} for t in times]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        counts = call_streams.action_counts(policy.decide(tables.stream_calls(spark, str(source), 1), policy.default_policy()))
        call_streams.count_stream(counts, out, log).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out).selectExpr("hour(window_start) AS h", "calls").collect()
    changes = spark.createDataFrame([(0, 1, "A", 1, 0), (0, 1, "A", 5, 2), (1, 2, "A", 3, 1)], "window_start int, window_end int, action string, calls long, batch_id int")
    changes.write.partitionBy("batch_id").parquet(str(tmp_path / "log of changes"))
    call_streams.compact_counts(spark, str(tmp_path / "log of changes"), str(tmp_path / "short"))
    assert sorted(tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "short")).collect()) == [(0, 1, "A", 5), (1, 2, "A", 3)]
    assert sorted(tuple(r) for r in found) == [(0, 1), (1, 1), (5, 2)]


def test_scores_stream_and_compaction(spark, tmp_path):
    source, store, log = tmp_path / "scans", str(tmp_path / "store"), str(tmp_path / "log")
    source.mkdir()
    for n, rows in enumerate([[("a", "RED", 1), ("a", "GREEN", 2), ("b", "RED", 1)], [("a", "YELLOW", 3), ("b", "GREEN", 0)]]):
        lines = [{"repo_key": k, "score": s, "scanned_at": f"2024-01-0{t + 1}T00:00:00", "seq": t} for k, s, t in rows]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, lines)))
        stream = spark.readStream.schema(schemas.SCAN_RESULTS).json(str(source))
        scan_streams.store_stream(stream, store, log).trigger(availableNow=True).start().awaitTermination()
    expected = [("a", "YELLOW"), ("b", "RED")]
    assert sorted((r.repo_key, r.score) for r in scan_streams.latest_scores(spark, store).collect()) == expected
    scan_streams.compact(spark, store, str(tmp_path / "compacted"))
    assert sorted((r.repo_key, r.score) for r in spark.read.parquet(str(tmp_path / "compacted")).collect()) == expected


def test_score_lookup(spark):
    stored = spark.createDataFrame([("github.com/o/r", "RED", None, 1)], schemas.SCAN_RESULTS)
    wanted = spark.createDataFrame([("https://github.com/O/R.git",), ("github.com/o/x",)], "url string")
    assert {r.repo_key: r.score for r in history.lookup(stored, wanted).collect()} == {"github.com/o/r": "RED", "github.com/o/x": "UNKNOWN"}
