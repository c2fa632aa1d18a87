"""The pipeline stage by stage against plain versions, and the registered queries against SQL."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from compare import connect, difference
from helpers import DOCS, awkward, empty
from test_near_copies import plain_groups, plain_set
from test_operators import SPLIT, plain_contamination, plain_targets
from toolguard.llm import quality, queries, toxicity
from toolguard.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_copies", "benchmark", "mixing"]
    docs = table(spark, FOLDER, "documents")
    labels = table(spark, FOLDER, "labels")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        expected = None
        if name in ("toxicity", "quality"):
            module, wanted = (toxicity, 0) if name == "toxicity" else (quality, 1)
            expected = Counter(r["doc_id"] for r in module.classify(docs, labels).collect() if r["predicted"] == wanted)
        elif name == "near_copies":
            sets = {r["doc_id"]: plain_set(r["text"]) for r in before}
            root = plain_groups(set(sets.values()))
            groups = defaultdict(list)
            for i, x in sets.items():
                groups[root[x]].append(i)
            expected = Counter(min(g) for g in groups.values())
        elif name == "benchmark":
            items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
            found = plain_contamination([(r["doc_id"], r["text"]) for r in before], items)
            expected = Counter(x[0] for x in found.elements() if not x[5])
        after = stage(spark, docs, FOLDER)
        rows = after.collect()
        if expected is None:
            sizes = Counter()
            for r in before:
                sizes[r["source"]] += len(SPLIT.findall(r["text"] or ""))
            got = Counter()
            for r in rows:
                got[r["source"]] += len(SPLIT.findall(r["text"] or ""))
            target = plain_targets(sizes)
            assert sum(abs(got[s] - target[s]) for s in target) < 0.15 * sum(target.values())
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
            assert after.columns == [*docs.columns, "copy"]
        else:
            assert Counter(r["doc_id"] for r in rows) == expected, name
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
            assert after.columns == docs.columns
            docs = spark.createDataFrame(rows, after.schema)
        kept[name] = len(rows)
    assert kept["toxicity"] > kept["quality"] > kept["near_copies"] > kept["benchmark"] > 0


def test_stages_take_awkward_and_empty_documents(spark):
    frame, rows = awkward(spark)
    for start in (frame.drop("copy"), empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert set(start.columns) <= set(docs.columns), name
        assert {r["doc_id"] for r in docs.collect()} <= {r[0] for r in rows}


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert DOCS


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_result_as_sql(spark, name):
    found = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert difference(found, connect(FOLDER).execute(queries.ORACLES[name]).fetchdf()) is None
