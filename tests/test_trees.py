"""Trees are listed without the folders that are left out, and contents are read and parsed once."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from toolguard import functions
from toolguard.functions import parsing
from toolguard.operators import extraction
from toolguard.sources import files, trees

KEPT = {"a/main.py": "x = 1\n", "a/src/deep/er/tool.ts": "é", "b/requirements.txt": "flask==1.0\n", "b/vendor/kept.js": "var a;", "top.py": ""}
LEFT = ["a/node_modules/lib/index.js", "a/.git/objects/ab", "b/src/Node_Modules/x.js", "b/build/out.py", "a/.venv/lib/site.py"]


@pytest.fixture
def tree(tmp_path):
    for path in [*KEPT, *LEFT]:
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(KEPT.get(path, "left out"), encoding="utf-8")
    os.symlink(tmp_path / "a", tmp_path / "a" / "src" / "again")  # a loop
    return tmp_path


def test_left_out_folders_are_never_opened(spark, tree, tmp_path_factory, monkeypatch):
    log = str(tmp_path_factory.mktemp("log"))
    made = trees.children

    def logged(files, root, folder, left_out):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w", encoding="utf-8") as file:
            file.write(folder)
        return made(files, root, folder, left_out)

    monkeypatch.setattr(trees, "children", logged)
    got = {r["path"]: r["size"] for r in trees.list_tree(spark, str(tree)).collect()}
    assert got == {p: len(t.encode()) for p, t in KEPT.items()}
    opened = set()
    for name in os.listdir(log):
        with open(f"{log}/{name}", encoding="utf-8") as file:
            opened.add(file.read())
    assert opened == {"", "a", "b", "a/src", "a/src/deep", "a/src/deep/er", "b/src", "b/vendor"}
    monkeypatch.undo()
    whole = spark.read.format("pruned_trees").load(f"file://{tree}").collect()
    assert {r["path"] for r in whole} == set(KEPT) and not any(r["is_open"] for r in whole)
    other = {r["path"] for r in trees.list_tree(spark, str(tree), left_out=("build",)).collect()}
    assert other == {*KEPT, *LEFT} - {"b/build/out.py"}


def test_wide_and_deep_trees_are_listed_by_many_tasks(spark, tmp_path):
    for i in range(60):
        folder = tmp_path / f"r{i}" / "/".join(f"d{j}" for j in range(i % 7))
        folder.mkdir(parents=True)
        (folder / "f.py").write_text(str(i))
    for i in range(40):  # one repository with many folders
        (tmp_path / "r0" / f"s{i}" / "t").mkdir(parents=True)
        (tmp_path / "r0" / f"s{i}" / "t" / "g.py").write_text("g")
    trees.register(spark)
    shares = spark.read.format("pruned_trees").option("shares", 8).load(str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) > 4
    plain = {os.path.relpath(os.path.join(d, f), tmp_path) for d, _, names in os.walk(tmp_path) for f in names}
    for folders in (1, 5, 4096):  # rounds of one folder a task
        got = [r["path"] for r in trees.list_tree(spark, str(tmp_path), shares=8, folders=folders).collect()]
        assert Counter(got) == Counter(plain)


def test_contents_are_read_for_chosen_files_only(spark, tree):
    found = trees.list_repos(spark, str(tree))
    assert {(r["repo_id"], r["path"]) for r in found.collect()} == {tuple(p.split("/", 1)) for p in KEPT if "/" in p}
    chosen = found.where(files.is_js_source(F.col("path")))
    for path in KEPT:  # what is not chosen is gone by then
        if path.endswith((".py", ".txt")):
            (tree / path).unlink()
    got = {r["tree_path"]: bytes(r["bytes"]).decode() for r in trees.with_contents(trees.spread(chosen), str(tree)).collect()}
    assert got == {p: KEPT[p] for p in ("a/src/deep/er/tool.ts", "b/vendor/kept.js")}


def test_each_content_is_parsed_once_in_the_corpus(spark, tmp_path, monkeypatch):
    code = 'import os\n@mcp.tool(name="t{k}")\ndef f(x):\n    """Reads."""\n    return os.environ[x]\n'
    rows = [(f"r{i % 9}", f"src/m{i}.py", code.format(k=i % 7)) for i in range(400)] + [("r1", "src/none.py", "x = 1\n"), ("r2", "a.js", "server.tool('j', 'd', {}, f)")]
    frame = spark.createDataFrame(rows, "repo_id string, path string, content string")
    root, log = str(tmp_path / "tree"), tmp_path / "log"
    log.mkdir()
    named = frame.withColumn("tree_path", F.concat_ws("/", "repo_id", "path"))
    assert trees.write_files(named.repartition(8), root) == len(rows)
    made, place = parsing.tools_of, str(log)

    def counted(language, content):
        import uuid

        with open(f"{place}/{uuid.uuid4().hex}", "w", encoding="utf-8") as file:
            file.write(content)
        return made(language, content)

    monkeypatch.setattr(parsing, "tools_of", counted)
    listed = files.tool_sources(trees.list_repos(spark, root))
    got = extraction.extract_once(listed, root).collect()
    parsed = Counter(p.read_text(encoding="utf-8") for p in log.iterdir())
    assert set(parsed.values()) == {1} and len(parsed) == 8
    monkeypatch.undo()
    assert functions
    want = extraction.extract_tools(files.tool_sources(frame)).collect()
    assert Counter(map(str, got)) == Counter(map(str, want)) and len(want) == 401
