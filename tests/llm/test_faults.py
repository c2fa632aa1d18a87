"""Clashing names, repeated ids, odd labels, word counts, long headers, low quality that lies in the wording."""

import random
from collections import Counter

import numpy as np
import pytest

from helpers import DOCS, awkward, empty, sentences
from test_operators import fold
from toolguard.llm import common, embeddings, mixing, quality, toxicity, warc


def test_mixing_keeps_a_column_named_copy(spark):
    frame, _ = awkward(spark)
    assert "copy" in frame.columns
    got = mixing.emit(frame)
    assert got.columns == [*frame.columns, "copy_"]
    rows = got.collect()
    assert {x["copy"] for x in rows} == {7} and {x["copy_"] for x in rows} >= {1, 2}
    again = mixing.emit(frame.withColumnRenamed("fp", "Copy_"))
    assert again.columns[-1] == "copy__"


def test_sample_is_bounded_in_rows_where_ids_repeat(spark):
    texts = sentences(3000, seed=5, words=12)
    rows = [(1, t) for t in texts] + [(2, "same")] * 2000 + [(i, t) for i, t in enumerate(texts[:60], 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    got = common.labelled(docs, labels, "quality", 200, seed=2).collect()
    assert 100 < len(got) < 300
    assert len({(x["doc_id"], x["text"]) for x in got}) == len(got)
    assert all(x["label"] == x["doc_id"] % 2 and not fold(x["doc_id"], 0) for x in got)
    few = common.labelled(docs.where("doc_id > 2"), labels, "quality", 200, seed=2).collect()
    assert {(x["doc_id"], x["text"]) for x in few} == {(i, t) for i, t in rows if i > 2 and not fold(i, 0)}
    assert 0 <= min(x["score"] for x in quality.classify(docs, labels, sample_size=200).collect())


def plain_weigh(model, folded):
    best = {}
    for entry, weight in model.lexicon.items():
        at = folded.find(entry)
        while at >= 0:
            best[at] = max(weight, best.get(at, 0.0))
            at = folded.find(entry, at + 1)
    for phrase in model.exceptions:
        at = folded.find(phrase)
        while at >= 0:
            best = {k: v for k, v in best.items() if not at <= k < at + len(phrase) - 1}
            at = folded.find(phrase, at + 1)
    return sum(w for w in best.values() if w > 0)


def test_matches_of_the_lexicon_against_plain_search():
    r = random.Random(1)
    for _ in range(200):
        words = lambda n: [" " + "".join(r.choices("ab", k=r.randrange(1, 4))) for _ in range(n)]  # noqa: E731, B023
        exceptions = [a + b + " " for a, b in zip(words(3), words(3), strict=True)]
        model = toxicity.Model({w: r.random() + 0.1 for w in words(4)}, exceptions, 0.0, 1.0)
        model.exceptions = [p for p in model.exceptions if p not in model.lexicon]
        folded = "".join(words(r.randrange(30))) + " "
        assert model.weigh(folded, model.matcher()) == pytest.approx(plain_weigh(model, folded))


def test_many_exceptions_take_no_quadratic_time():
    model = toxicity.Model({" scum": 1.0}, [" pond scum "], 0.0, 1.0)
    assert model.weigh(" pond scum" * 200_000 + " scum ", model.matcher()) == 1.0


def test_words_are_counted_alike_in_fitting_and_scoring(spark):
    docs = spark.createDataFrame([(1, "don't you e-mail x@y.z wretch")], "doc_id long, text string")
    model = toxicity.Model({" wretch": 2.0}, [], -1.0, 0.7)
    words = len(toxicity.fold_text("don't you e-mail x@y.z wretch", toxicity.Folding()).split())
    assert words == 8
    assert toxicity.score(docs, model).first()["score"] == pytest.approx(model.score(2.0, words))


def test_short_words_can_be_toxic(spark):
    r, rows = random.Random(4), []
    for i, t in enumerate(sentences(600, seed=13, words=30)):
        words, toxic = t.split(), int(i % 4 == 0)
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words) + 1), "zqx")
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([x[:2] for x in rows] + [(9000, "zqxel zqxa plain words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert " zqx " in model.lexicon
    got = {x["doc_id"]: x["predicted"] for x in toxicity.classify(docs, labels).collect()}
    assert sum(got[i] != y for i, _, y in rows) < 0.02 * len(rows) and got[9000] == 0


@pytest.mark.parametrize("kind, names", [("string", ["a", "b"]), ("long", [1, 1 << 40])])
def test_labels_of_any_type(spark, kind, names):
    r = np.random.default_rng(3)
    base = r.standard_normal((20, 8))
    rows = [(i, (base[i // 2] + 0.001 * r.standard_normal(8)).tolist(), names[(i // 20) % 2]) for i in range(40)] + [(90, base[0].tolist(), names[1]), (91, base[0].tolist(), None)]
    got = {x["vec_id"]: x for x in embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    assert all(got[i]["n_links"] == 1 and got[i]["component_id"] == i - i % 2 for i in range(40))
    assert got[90]["n_links"] == got[91]["n_links"] == 0


def test_long_header_blocks_are_no_payload():
    walk = warc.Walk("x")
    header = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 200_000 + b"\r\n\r\n"
    block = header + b"payload"
    head = f"WARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    assert walk.chunk(b"") == []
    (row,) = walk.chunk(head + block + b"\r\n\r\n")
    assert row[-2] == len(b"payload")


def worded(n, seed):
    """Clean spelling throughout; low quality is a matter of the words that are chosen."""
    r, rows = random.Random(seed), []
    shape = lambda: "".join(r.choices("bcdfglmnprst", k=2)) + r.choice(["ane", "olo", "iri"])
    prose, adverts = [shape() + "a" for _ in range(300)], [shape() + "o" for _ in range(40)]
    for i in range(n):
        bad = i % 3 == 0
        words = [r.choice(adverts if bad and r.random() < 0.5 else prose) for _ in range(r.randrange(30, 80))]
        rows.append((i, " ".join(words).capitalize() + ".", "en", "s", int(not bad)))
    return rows


def test_low_quality_in_the_wording_is_told(spark):
    rows = worded(900, 2)
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, y) for i, *_, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.share > 0
    got = {x["doc_id"]: x for x in quality.classify(docs, labels).collect()}
    held = [(i, y) for i, *_, y in rows if got[i]["held_out"]]
    assert len(held) > 100 and sum(got[i]["predicted"] != y for i, y in held) <= 0.03 * len(held)
    assert quality.classify(empty(spark), labels).count() == 0


def test_votes_against_all_cosines(spark):
    rows = worded(300, 7)
    docs = spark.createDataFrame(rows, DOCS)
    model = quality.fit(docs, spark.createDataFrame([(i, y) for i, *_, y in rows], "doc_id long, quality int"))
    got = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    reader = quality.Reader()
    for i, text, *_ in rows[:60]:
        x = model.vector(reader.rows([text]))[0].astype(float)
        near = sorted(((float(v @ x), float(y)) for v, y in zip(model.vectors.astype(float), model.votes)), key=lambda p: -p[0])[: quality.NEIGHBOURS]
        weights = [max(c, 0.0) ** 4 for c, _ in near]
        assert got[i] == pytest.approx(sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights), abs=2e-3)
    assert Counter(got) == Counter({i: got[i] for i, *_ in rows})
