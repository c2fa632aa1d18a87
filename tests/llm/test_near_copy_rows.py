"""What the near-copy stage moves, compares and leaves behind."""

import os
import random
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helpers import awkward, sentences
from test_near_copies import found_pairs
from toolguard import scale
from toolguard.llm import common, near_copies, simhash


def test_parities_never_part_similar_sets(spark):
    r, rows, want = random.Random(4), [], []
    for i in range(300):
        n = r.choice([1, 3, 20, 127, 128, 130, 500, 515, 1000, 2060])
        shared = {r.getrandbits(64) for _ in range(n)}
        a, b = (np.array(sorted(shared | {r.getrandbits(64) for _ in range(r.randrange(0, 1 + n // 4))}), dtype=np.uint64) for _ in range(2))
        if i % 3 == 0:
            b = np.array(sorted({r.getrandbits(64) for _ in b}), dtype=np.uint64)  # shares nothing
        both = len(np.intersect1d(a, b))
        want.append((9 * both >= 4 * (len(a) + len(b)), both))
        rows.append((i, len(a), len(b), near_copies.parities(a).tolist(), near_copies.parities(b).tolist()))
    frame = spark.createDataFrame(rows, "i int, na long, nb long, oa array<long>, ob array<long>")
    can = near_copies.fits("na", "nb") & near_copies.differ_little("oa", "ob", "na", "nb")
    got = {x["i"]: x["can"] for x in frame.select("i", can.alias("can")).collect()}
    assert all(got[i] for i, (similar, _) in enumerate(want) if similar) and sum(x[0] for x in want) > 50
    assert any(len(x[3]) != len(x[4]) and want[x[0]][0] for x in rows)  # folded ones are among them
    assert not any(got[i] for i, (_, both) in enumerate(want) if not both and rows[i][1] > 100)


def test_a_very_common_passage_hides_no_centres(spark, monkeypatch):
    """Near copies that share a passage with many other texts meet a centre of their own."""
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**6)}"
    passage, base = [word() for _ in range(16)], [word() for _ in range(120)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(118))])) for i in range(400)]
    for i in range(400, 700):
        own = list(base)
        own[r.randrange(120)] = word()
        rows.append((i, " ".join([*passage, *own])))
    compared = []
    made = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *x: compared.append(pairs.count()) or made(pairs, *x))
    root = found_pairs(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert len({root[i] for i in range(400, 700)}) == 1 and len(set(root.values())) == 401
    assert sum(compared) <= len(rows)


def test_tables_go_when_the_stage_is_done(spark, monkeypatch):
    made, sizes = [], []

    def watched(df):
        table = scale.materialize(df)
        made.append(urlparse(table.inputFiles()[0]).path.rsplit("/", 1)[0])
        sizes.append(sum(e.stat().st_size for e in os.scandir(made[-1])))
        return table

    monkeypatch.setattr(near_copies, "materialize", watched)
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(300)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(f"{t} more" for t in texts[:50])])], "doc_id long, text string")
    assert near_copies.keep_one(docs).count() == 150
    # The first table is read to the end; in small inputs its counters, which are of fixed size, are most of it.
    left = [n for path, n in zip(made[1:], sizes[1:], strict=True) if os.path.exists(path)]
    assert sum(left) < 0.1 * sum(sizes[1:])


def test_a_sieve_loses_nothing(spark, monkeypatch):
    for log in (27, 10):  # the small one lets many others pass, which the join after it drops
        monkeypatch.setattr(common, "SIEVE_LOG", log)
        inside = spark.range(500).select(F.xxhash64("id").alias("h"))
        passes = common.sieve(inside)
        assert inside.where(passes(F.col("h"))).count() == 500
        other = spark.range(1000, 4000).select(F.xxhash64("id").alias("h")).where(passes(F.col("h"))).count()
        assert (other < 300) == (log == 27)
    assert spark.range(9).select(F.xxhash64("id").alias("h")).where(common.sieve(inside.where("false"))(F.col("h"))).count() == 0


def test_without_and_at_places_are_joins(spark):
    frame, rows = awkward(spark, [(i, t, "en", "s", 1) for i, t in enumerate(sentences(20, seed=2))])
    places = frame.where((F.coalesce("doc_id", F.lit(0)) % 2 == 0)).select(F.col("doc_id").alias("__id"), simhash.text_key().alias("__key")).distinct()
    even = Counter((x[0], x[1]) for x in rows if (x[0] or 0) % 2 == 0)
    every = Counter((x[0], x[1]) for x in rows)
    assert Counter((x["doc_id"], x["text"]) for x in simhash.without(frame, places).collect()) == every - even
    got = Counter((x["doc_id"], x["text"] or "") for x in simhash.at_places(frame, places).collect())
    assert got == Counter((i, t or "") for (i, t), n in even.items() for _ in range(n))


def test_no_task_of_near_copies_needs_two_workers(spark, capsys):
    """A test in Python before a step in Python holds two workers a core, and whole rows between them."""
    passes = common.sieve(spark.range(50).select(F.xxhash64("id").alias("h")))
    spark.range(9).where(passes(F.xxhash64("id"))).explain()
    assert "Python" not in capsys.readouterr().out


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key), spark.conf.get(rows)
    spark.conf.set(key, "64m")
    spark.conf.set(rows, "10000")
    try:
        docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"))
        held = common.filter_rows(docs, lambda: lambda texts: [True] * len(texts))
        assert spark.conf.get(key) == f"{common.ARROW_BYTES}b"
        sizes = common.map_arrow(docs, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
        assert sizes.agg(F.max("n")).first()[0] <= common.BATCH_BYTES
        assert held.count() == 2000
        spark.conf.set(key, "1m")
        common.limit_batches(spark)  # a lower limit stays
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set(rows, before[1])
