"""The near-copy stage against all pairs of plain five-word shingle sets."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from helpers import awkward, empty, sentences
from test_operators import LOWER, SPLIT, plain_components
from toolguard.llm import near_copies, simhash


def plain_set(text):
    words = SPLIT.findall((text or "").translate(LOWER))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(sets):
    sets = list(sets)
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a | b and 5 * len(a & b) >= 4 * len(a | b)]
    root = plain_components(range(len(sets)), near)
    return {s: root[i] for i, s in enumerate(sets)}


@pytest.mark.parametrize("turns", [1, 8])
def test_edited_copies_go(spark, monkeypatch, turns):
    # After one turn of stars more is left to the pairs between groups.
    monkeypatch.setattr(near_copies.roots_of, "__defaults__", (turns,))
    r = random.Random(7)
    edited = []
    for k, base in enumerate(sentences(12, seed=21, words=700)):
        words = base.split()
        for i in range(60 if k == 0 else 5):  # one large group
            copy = list(words)
            for _ in range(max(1, len(words) // r.choice([30, 60, 100]))):
                copy[r.randrange(len(copy))] = f"zz{r.randrange(50)}"
            edited.append((1000 + 100 * k + i, " ".join(copy), "en", "s", 1))
    frame, rows = awkward(spark, edited)
    root = plain_groups({plain_set(x[1]) for x in rows})
    kept = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert kept.columns == frame.columns
    got = kept.collect()
    assert Counter(root[plain_set(x["text"])] for x in got) == Counter(set(root.values()))
    least = {}
    for x in rows:
        if x[0] is not None:
            least[root[plain_set(x[1])]] = min(x[0], least.get(root[plain_set(x[1])], x[0]))
    assert all(x["doc_id"] == least.get(root[plain_set(x["text"])]) for x in got)
    # Fingerprints within two bits, which the stage went by before, leave most of them.
    assert simhash.keep_one(frame).count() > 1.3 * len(got)
    assert corpus_pipeline.drop_near_copies(spark, empty(spark), "").count() == 0


def test_similarity_is_exact_at_the_threshold(spark):
    words = [f"w{i}" for i in range(40)]  # 36 shingles; 32 of 40 in both is 0.8, one less is not
    rows = [(1, " ".join(words)), (2, " ".join([*words[:36], "a", "b", "c", "d"]))]
    rows += [(3, " ".join([*words[:35], "e", "f", "g", "h", "i"]))]  # 31 of 41 with the first, and 31 of 41 with the second
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in near_copies.keep_one(docs).collect()} == {1, 3}


def found_pairs(spark, docs):
    """Roots of sets by their plain sets."""
    marked, found = near_copies.groups(docs)
    root = {x["fp"]: x["root"] for x in found.collect()}
    return {x["doc_id"]: root[x["fp"]] for x in marked.collect()}


@pytest.mark.parametrize("count", [300, 1200])
def test_pairs_among_texts_that_share_most_words(spark, count):
    """Pairs of similarity 0.82 or so; any other two texts share most of their shingles, but too few."""
    r = random.Random(count)
    common = [f"c{r.randrange(10**6)}" for _ in range(860)]
    rows = []
    for i in range(count // 2 if count > 300 else count):
        own = [f"o{i}x{j}" for j in range(115)]
        for k in (0, 1):
            rows.append((2 * i + k, " ".join([*common, *own, *(f"e{i}x{k}x{j}" for j in range(70))])))
    a, b, c = (plain_set(rows[i][1]) for i in (0, 1, 2))
    assert 0.82 < len(a & b) / len(a | b) < 0.9 and 0.65 < len(a & c) / len(a | c) < 0.8
    root = found_pairs(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert all(root[2 * i] == root[2 * i + 1] for i in range(len(rows) // 2))
    assert len(set(root.values())) == len(rows) // 2


def test_candidates_of_a_large_group_are_few(spark, monkeypatch):
    """In a group of 700 each set is compared with a few centres, not with all others."""
    r = random.Random(5)
    base = [f"w{r.randrange(3000)}" for _ in range(400)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(r.randrange(1, 5)):
            words[r.randrange(400)] = f"z{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    compared = []
    made = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *x: compared.append(pairs.count()) or made(pairs, *x))
    root = found_pairs(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert len(set(root.values())) == 1
    assert sum(compared) <= 3 * len(rows)


def test_chains_and_sizes_against_all_pairs(spark):
    """Texts drawn from few words, so that similarities of all sizes come up, and cut ones, so that lengths differ."""
    r = random.Random(11)
    rows = []
    for k in range(25):
        words = [f"w{r.randrange(60)}" for _ in range(r.randrange(5, 120))]
        for _ in range(14):
            copy = list(words)
            for _ in range(r.randrange(0, 1 + len(words) // 20)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(60)}"
            cut = r.randrange(0, 1 + len(copy) // 5)
            rows.append((len(rows), " ".join(copy[cut:] if r.random() < 0.5 else copy[: len(copy) - cut])))
            words = copy if r.random() < 0.5 else words
    want = plain_groups({plain_set(t) for _, t in rows})
    got = found_pairs(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert len({(want[plain_set(t)], got[i]) for i, t in rows}) == len(set(want.values())) == len(set(got.values()))


def test_prefixes_of_similar_sets_meet():
    r, firsts = random.Random(3), near_copies.bounds()
    for _ in range(400):
        shared = np.array(r.sample(range(10**9), r.randrange(1, 60)), dtype=np.uint64) << np.uint64(20)
        sets = [np.unique(np.concatenate([shared, np.array(r.sample(range(10**9), r.randrange(0, 12)), dtype=np.uint64) << np.uint64(20)])) for _ in range(2)]
        a, b = sorted(sets, key=len)
        if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
            continue
        weights = np.random.default_rng(1).integers(0, 3, 1 << near_copies.COUNTERS_LOG).astype(np.float32)
        (ka, _, ra), (kb, _, rb) = (near_copies.prefix_rows(x, weights, firsts) for x in (a, b))
        assert set(ka[ra & 1 == 1]) & set(kb[rb & 2 == 2])
