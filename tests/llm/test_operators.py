"""Each operator against a plain version on a small table, with awkward rows."""

import hashlib
import base64
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from helpers import DOCS, awkward, empty, sentences
from toolguard.llm import chat, decontamination, embeddings, language_model, mixing, quality, simhash, tokens, toxicity, warc
from toolguard.llm.common import word_count
from toolguard.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = SPLIT.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def fold(i, k):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == k


def test_covering_masks_miss_every_pair():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_components(spark):
    r = random.Random(3)
    linked = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    want = plain_components({x for e in linked for x in e}, linked)
    frame = spark.createDataFrame([*linked, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(frame, "a", "b").collect()}
    assert got == {n: want[n] for e in linked for n in e if e[0] != e[1]}


@pytest.mark.parametrize("pairs", [0, 2, 32])
def test_links_of_fingerprints(spark, pairs):
    r = random.Random(pairs)
    values = set()
    for _ in range(12):
        x = r.getrandbits(64)
        values |= {x} | {x ^ (1 << r.randrange(64)) ^ (r.random() < 0.5) * (1 << r.randrange(64)) for _ in range(25)}
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = [(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in simhash.links(frame, pairs).collect()]
    near = [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 2]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in got)
    assert plain_components(values, got) == plain_components(values, near)


def test_simhash(spark):
    base = sentences(1, seed=5, words=900)[0].split()
    near = [(200 + i, " ".join([*base[:i], "zz", *base[i + 1 :]]), "en", "s", 1) for i in range(12)]
    frame, rows = awkward(spark, near)
    got = simhash.near_duplicates(frame).collect()
    prints = {(r[0], r[1]): plain_fingerprint(r[1]) for r in rows}
    distinct = set(prints.values())
    root = plain_components(distinct, [(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 2])
    ids = defaultdict(list)
    for (i, t), fp in prints.items():
        if i is not None:
            ids[root[fp]].append(i)
    want = Counter((r[0], prints[r[0], r[1]], min(ids[root[prints[r[0], r[1]]]], default=None)) for r in rows)
    assert Counter((x["doc_id"], x["fp"] % (1 << 64), x["component_id"]) for x in got) == want
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert Counter(root[prints[x["doc_id"], x["text"]]] for x in kept.collect()) == Counter(set(root.values()))
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    frame, rows = awkward(spark, [(300, "It's <|endoftext|>can't 123 Áb  c", "en", "s", 1), (301, "x" * 3000, "en", "s", 1)])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    want = Counter((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 2048) for r in rows)
    assert Counter(map(tuple, tokens.count_tokens(frame).collect())) == want
    piece = tokens.count_tokens(frame.limit(4), "piece_bpe_32k.model").collect()
    assert all(x["n_tokens"] > 0 for x in piece)
    assert tokens.count_tokens(empty(spark)).count() == 0


def test_pieces_add_up():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(4)
    alphabet = [*"abcTHEing XYZ'stdm .,!<|>0123é́ ̈KΣ​\x1c\x85 \n\t", "<|endoftext|>", "'s", "'ll"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    plain = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.tokenizers_counter(path).counts(texts) == plain


def test_chat(spark):
    r = random.Random(6)
    parts = ["</s>", "<s>", "[INST]", " [/INST]", "[INST] ", "<<SYS>> ", " <</SYS>>", "[ROLE] ", " [/ROLE]", "\\", "\\-", "\\+", "<", "[", " ", "\n", "é", "🙂", "ok"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool x", None]), "".join(r.choices(parts, k=r.randint(0, 9))))
            for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(None, 1, "user", "a"), (7, None, "assistant", None), (900, 0, "assistant", "long \\ text " * 20000), (901, 0, "user", "x"), (901, 0, "user", "x")]
    frame = spark.createDataFrame([(*x, 7) for x in rows], "conv_id long, turn long, role string, text string, at int")
    got = {x["conv_id"]: x for x in chat.round_trip(frame).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = chat.format_chats(frame).collect()
    for x in formatted:  # control strings stand at the template's places only
        text = bytes(x["formatted"]).decode()
        assert text.count("</s>") == sum(t[2] == "assistant" for t in groups[x["conv_id"]])
        assert text.count("[INST]") == sum(t[2] == "user" for t in groups[x["conv_id"]])
    assert chat.round_trip(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((700, 16))
    rows = [(i, [float(v) for v in x], i % 3) for i, x in enumerate(base)]
    for i in range(400):  # a large group of near copies, and pairs at all distances
        rows.append((1000 + i, [float(v) for v in base[0] + 0.12 * r.standard_normal(16)], 0))
        rows.append((2000 + i, [float(v) for v in base[i] + r.uniform(0, 0.5) * r.standard_normal(16)], i % 3))
    rows += [(3000, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (3001, [2 * v for v in rows[6][1]], rows[6][2]), (None, rows[7][1], rows[7][2])]
    bad = [(4000, None, 0), (4001, [], 0), (4002, [0.0] * 16, 0), (4003, [1.0, None] * 8, 0), (4004, [float("nan")] * 16, 0),
           (4005, [float("inf")] * 16, 0), (4006, rows[0][1], None), (4007, [1.0, 2.0], 0), (4008, [2.0, 4.0], 0)]
    schema = "vec_id long, embedding array<double>, label int"
    frame = spark.createDataFrame(rows + bad, schema).selectExpr("*", "7L as node", "'x' as vector", "1 as usable")
    got = embeddings.near_duplicates(frame).collect()
    x = np.array([v[1] for v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([v[2] for v in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    degree = near.sum(axis=1)
    root = plain_components(range(len(rows)), zip(*(k.tolist() for k in np.nonzero(near)), strict=True))
    least = defaultdict(list)
    for i, v in enumerate(rows):
        if v[0] is not None:
            least[root[i]].append(v[0])
    want = Counter((v[0], int(degree[i]), min(least[root[i]])) for i, v in enumerate(rows))
    found = Counter((g["vec_id"], g["n_links"], g["component_id"]) for g in got if g["vec_id"] is None or g["vec_id"] < 4000)
    total = sum(g["n_links"] for g in got if g["vec_id"] is None or g["vec_id"] < 4000)
    assert 0.98 * degree.sum() <= total <= degree.sum()
    assert sum((want & found).values()) >= 0.97 * len(rows)
    odd = {g["vec_id"]: (g["n_links"], g["component_id"], g["kept"]) for g in got if g["vec_id"] is not None and g["vec_id"] >= 4000}
    assert odd == {**{i: (0, i, True) for i in range(4000, 4007)}, 4007: (1, 4007, True), 4008: (1, 4007, False)}
    assert embeddings.near_duplicates(empty(spark, schema)).count() == 0


def test_multi_sequence_visits_nearest_cells():
    r = np.random.default_rng(1)
    index = embeddings.Index(r.standard_normal((9, 4)), r.standard_normal((7, 4)), 1)
    x = r.standard_normal((50, 8))
    d = (embeddings.distances(x[:, :4], index.first)[:, :, None] + embeddings.distances(x[:, 4:], index.second)[:, None, :]).reshape(50, -1)
    for visits in (1, 5, 20, 63):
        got = index.traversal(x, visits)
        assert np.allclose(np.take_along_axis(d, got, 1), np.sort(d, axis=1)[:, :visits])


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    cut = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in cut)
        total = sum(weight[s] for s in names if s not in cut)
        over = {s for s in names if s not in cut and left * weight[s] / total > most * sizes[s] * (1 + 1e-12)} if total else set()
        if not over:
            return {s: most * sizes[s] if s in cut else left * weight[s] / total for s in names}
        cut |= over


def test_mixing(spark):
    many = [(1000 + i, t, "en", f"t{i % 40:02d}" if i % 3 else "hot", 1) for i, t in enumerate(sentences(1500, seed=8))]
    frame, rows = awkward(spark, many)
    got = mixing.mix(frame).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(SPLIT.findall(r[1] or ""))
    want = plain_targets(sizes)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0], len(SPLIT.findall(r[1] or ""))].append(r[3])
    assert len(got) == len(rows)
    taken = Counter()
    for x in got:
        source = next(s for s in by_id[x["doc_id"], x["size"]] if sizes[s] == x["source_size"])
        assert x["target"] == pytest.approx(want[source])
        assert x["taken"] <= 3 * x["size"]
        assert x["size"] == 0 or x["taken"] % x["size"] == 0
        taken[source] += x["taken"]
    for s in ("hot", "t01", "t02"):
        assert taken[s] == pytest.approx(want[s], rel=0.05)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(frame).collect()))
    emitted = mixing.emit(frame.drop("copy"))
    assert emitted.columns == [*frame.drop("copy").columns, "copy"]
    lengths = Counter()
    for x in emitted.collect():
        lengths[x["source"]] += len(SPLIT.findall(x["text"] or ""))
    assert {s: n for s, n in lengths.items() if n} == {s: n for s, n in taken.items() if n}
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.emit(empty(spark)).count() == 0


def test_ranks_follow_code_points(spark):
    names = ["b", "a", "Z", "é", "🙂", "￮", "", None, *(f"x{i}" for i in range(300))]
    got = {r["source"]: r["rank"] for r in mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    want = sorted((n for n in names if n is not None)) + [None]
    assert got == {n: i for i, n in enumerate(want)}


def test_word_count(spark):
    texts = ["", " ", "a", " a", "a ", "\ta\x0bb\x0c\r\nc ", None, "a b c\x1cd", "\x85"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", word_count("text").alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(SPLIT.findall(t or "")) for i, t in enumerate(texts)}


def test_language_model(spark):
    frame, rows = awkward(spark, [(1000 + i, t, "en", "s", 1) for i, t in enumerate(sentences(200, seed=2))])
    got = language_model.score(frame, most=100).collect()  # most words outside the dictionary
    words = lambda t: SPLIT.findall((t or "").translate(LOWER)) + [None]
    counts = Counter(w for r in rows if not fold(r[0], 1) for w in words(r[1]))
    total, different = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (different + 1))) for w in words(t))
    want = Counter((r[0], fold(r[0], 1), len(words(r[1])), sum(counts[w] > 0 for w in words(r[1])), total, round(base(r[1]), 6)) for r in rows)
    assert Counter((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    assert all(x["score"] < 0 and math.isfinite(x["score"]) for x in got)
    assert language_model.score(empty(spark)).count() == 0


def test_network_probabilities_and_gradients():
    lex = language_model.lexicon([(b"w%d" % i, 50 - i) for i in range(40)], 10, ["ab", "cd"])
    r = np.random.default_rng(0)
    network = language_model.Network(language_model.Network.start(lex, np.ones(lex.size)), lex)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    h = r.standard_normal((3, language_model.HIDDEN))
    every = np.exp([network.log_probabilities(h, np.full(3, s)) for s in range(lex.size)])
    assert np.allclose(every.sum(axis=0), 1.0)
    documents = [np.array([*r.integers(1, lex.size, n), 0]) for n in (1, 5, 70, 130)]
    alone = []
    for d in documents:
        h, last, total = np.zeros((1, language_model.HIDDEN)), np.zeros(1, dtype=int), 0.0
        for s in d:
            h = network.step(last, h)[0]
            last = np.array([s])
            total += network.log_probabilities(h, last)[0]
        alone.append(total)
    assert np.allclose(language_model.log_likelihoods(network, documents), alone, rtol=1e-4)
    inputs, targets = r.integers(0, lex.size, (6, 4)), r.integers(0, lex.size, (6, 4))
    fresh, start = inputs == 0, r.standard_normal((4, language_model.HIDDEN))

    def loss():
        h, found = start, 0.0
        for t in range(6):
            h = network.step(inputs[t], np.where(fresh[t][:, None], 0.0, h))[0]
            found -= network.log_probabilities(h, targets[t]).sum() / targets.size
        return found

    grads, _ = network.train_window(inputs, targets, fresh, start)
    for k, place in (("x", (inputs[0, 0], 3)), ("u", (2, 5)), ("c", (1, 4)), ("cb", (2,)), ("u", (4, 2 * language_model.HIDDEN + 6))):
        network.p[k][place] += 1e-5
        up = loss()
        network.p[k][place] -= 2e-5
        slope = (up - loss()) / 2e-5
        network.p[k][place] += 1e-5
        assert grads[k][place] == pytest.approx(slope, rel=2e-2, abs=1e-6), k


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, column):
    good, r = sentences(500, seed=3), random.Random(1)
    rows = []
    for i, t in enumerate(good):
        bad = i % 4 == 0
        words = t.split()
        if bad and column == "toxic":
            for _ in range(max(1, len(words) // 12)):
                words.insert(r.randrange(len(words) + 1), r.choice(["Wretchedly", "wr3tched", "wrеtch"]))
        elif bad:
            words = [w + "&&&" for w in words]
        rows.append((i, " ".join(words), "en", "s", int(bad)))
    frame, _ = awkward(spark)
    frame = frame.where("false").unionByName(spark.createDataFrame(rows, DOCS), allowMissingColumns=True)
    odd = spark.createDataFrame([(None, "x", None, None, None), (7000, None, None, None, None), (7001, "", None, None, None), (7002, good[1], "en", "s", 1), (7002, good[1], "en", "s", 1)], DOCS)
    frame = frame.unionByName(odd, allowMissingColumns=True)
    truth = {i: (bad if column == "toxic" else 1 - bad) for i, _, _, _, bad in rows}
    labels = spark.createDataFrame([*((i, y) for i, y in truth.items()), (None, 1), (3, None), (3, truth[3])], f"doc_id long, {column} int")
    got = module.classify(frame, labels).collect()
    assert len(got) == len(rows) + 5
    assert all(0 <= x["score"] <= 1 and x["held_out"] == fold(x["doc_id"], 0) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.95 * len(held)
    keep = module.reject if column == "toxic" else module.keep_good
    kept = keep(frame, labels)
    assert kept.columns == frame.columns
    stays = Counter(x["doc_id"] for x in got if x["predicted"] == (column == "quality"))
    assert Counter(x["doc_id"] for x in kept.collect()) == stays
    assert module.classify(empty(spark), labels).count() == 0
    none = module.classify(frame, labels.where("false")).collect()
    assert len(none) == len(got)


def test_lexicon_skips_words_that_only_copies_share(spark):
    passage = sentences(1, seed=77, words=50)[0]
    rows = [(i, f"{t} {passage} {t}", i % 2) for i, t in enumerate(sentences(60, seed=4))]
    rows += [(100 + i, t, 0) for i, t in enumerate(sentences(200, seed=5))]
    sample = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int")
    assert not toxicity.learn_lexicon(sample, 30, 230)


def test_folding_and_exceptions():
    table = toxicity.Folding()
    assert toxicity.fold_text("Id10t! ѕсυm, Ïdiot", table).split() == ["idiot", "scum", "idiot"]
    model = toxicity.Model({" scum": 2.0, " scu": 1.0}, [" pond scum"], 0.0, 1.0)
    matcher = model.matcher()
    assert model.weigh(toxicity.fold_text("scum and pond scum, obscum", table), matcher) == 2.0


def plain_contamination(rows, items, window=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate(LOWER))
    grams = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[a : a + n])].add(i)
    found = []
    for r in rows:
        w, hit, listed = split(r[1]), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in grams:
                    hit |= set(range(a, a + n))
                    listed |= grams[g]
        names = sorted(str(x) for x in listed if x is not None)
        found.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(found)


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, short):
    passages = sentences(12, seed=31, words=40)
    items = [(i, p) for i, p in enumerate(passages) if short or len(p.split()) >= 13] + [(50, None), (51, "")]
    items += [(70, "ΑΣ'α ΟΔΟΣ " + passages[4] + " Έ " + passages[5])]
    items += [(52, "One two"), (53, "abc"), (None, passages[0]), (1, passages[2]), (54, "a b c d e f g h i")] if short else [(60, passages[0] + " " + passages[1])]
    r = random.Random(2)
    mixed = [(490, "x, ΑΣ α-ΟΔΟΣ. " + passages[4] + " Έ " + passages[5], "en", "s", 1), (491, "ασ α οδος " + passages[4], "en", "s", 1)]
    for i in range(40):
        w = passages[i % 12].upper().split()
        a = r.randint(0, max(0, len(w) - 14))
        text = sentences(1, seed=100 + i, words=r.choice([5, 80, 300]))[0] + ", " + " ".join(w[a : a + r.randint(10, 30)]) + "; " + sentences(1, seed=200 + i)[0]
        mixed.append((500 + i, text if i % 5 else text + " One-Two " + passages[3] * 3, "en", "s", 1))
    frame, rows = awkward(spark, mixed)
    benchmark = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, length int")
    got = decontamination.contamination(frame, benchmark).collect()
    want = plain_contamination(rows, items)
    assert Counter(map(tuple, got)) == want
    kept = decontamination.decontaminate(frame, benchmark)
    assert kept.columns == frame.columns
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(x[0] for x in want.elements() if not x[5])
    assert decontamination.contamination(empty(spark), benchmark).count() == 0
    assert not any(x["n_hit"] for x in decontamination.contamination(frame, empty(spark, "item_id long, text string")).collect())


def test_warc(spark):
    evil = "x WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    far = "WARC/1.1\r\nContent-Length: 100000\r\n\r\n"
    htmls = [evil, far, far * 50, "WARC/1.1\r\n", "WARC/1.1\r\n" * 3 + "é", "", None, "a", "a", "a", "b🙂\r\n\r\n", evil + "tail", "<p>" + "long " * 50000, "WARC/1.1\r\nno header"]
    rows = [(i, f"http://x.org/{i}\r\nX: y", h) for i, h in enumerate(htmls)] + [(None, None, "a"), (None, "u", "n"), (9, "u", "a"), (20, "u", "q"), (20, "u", "q")]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    for least in (0, 2):
        got = warc.round_trip(frame, least).collect()
        last = {}
        for i, _, h in rows:
            h = h or ""
            if len(h.encode()) >= least and i is not None:
                last[h] = max(i, last.get(h, i))
        want = Counter()
        for i, _, h in rows:
            h = h or ""
            data = h.encode()
            revisit = h in last and i != last[h]
            want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[h] if revisit else None] += 1
        assert Counter(map(tuple, got)) == want
    assert warc.round_trip(empty(spark, "page_id long, url string, html string")).count() == 0


def test_warc_jumps_from_the_start_only(spark):
    # Runs of one file: 0 jumps over a look-alike run; another look-alike leads back into the chain.
    rows = [("f", 0, 0, 40), ("f", 10, 10, 20), ("f", 20, 20, 40), ("f", 40, 40, 90), ("f", 50, 50, 77), ("f", 90, 90, 99), ("g", 5, 5, 9)]
    found = spark.createDataFrame(rows, "file string, head long, start long, next long")
    assert {tuple(r) for r in warc.reachable(found).collect()} == {("f", 0), ("f", 40), ("f", 90)}
