"""That the network learns from every training document, and repeated rows once."""

from collections import Counter

import numpy as np

from helpers import DOCS, sentences
from toolguard.llm import language_model


def test_every_training_document_is_learned_from(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(language_model, "SHARD", 400)
    texts = sentences(1800, seed=12, words=8)
    rows = [(i if i % 2 else None, t, "en", "s", 1) for i, t in enumerate(texts)] + [(7, texts[7], "en", "s", 1)] * 50
    frame = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    tokens = sum(len(language_model.tokenize(r[1])) + 1 for r in rows)
    lex = language_model.lexicon([(b"w", 1)], 1, ["ab"])
    folder = str(tmp_path)

    made = language_model.parameter_row

    def recorder(shared, fields, rate):
        def learn(table):
            name = f"{table['shard'][0].as_py()}-{rate}"
            with open(f"{folder}/{name}", "w") as file:
                file.writelines(f"{i} {k}\n" for i, k in zip(table["doc_id"].to_pylist(), table["key"].to_pylist()))
            values = shared.value
            return made(table["shard"][0].as_py(), table.num_rows, [values[k] for k in sorted(values)])

        return learn

    monkeypatch.setattr(language_model, "learner", recorder)
    start = language_model.Network.start(lex, np.ones(lex.size))
    parameters = language_model.train(frame, lex, np.ones(lex.size), tokens)
    assert all(np.allclose(parameters[k], start[k], rtol=1e-5) for k in start)
    files = list(tmp_path.iterdir())
    seen = Counter(line for f in files for line in f.read_text().splitlines())
    assert set(seen.values()) == {1}
    assert len(seen) == len({(r[0], r[1]) for r in rows})  # 1,800 of them; a sample of 1,600 was the most before
    assert len({f.name.split("-")[0] for f in files}) > language_model.GROUP  # and averaged by groups


def test_every_symbol_counts_once_in_a_shard(monkeypatch):
    """Whatever the length: what is filled up behind the last symbol weighs nothing, and none is cut off."""
    monkeypatch.setattr(language_model, "STREAMS", 8)
    lex = language_model.lexicon([(b"w%d" % i, 50 - i) for i in range(40)], 10, ["ab", "cd"])
    r = np.random.default_rng(0)
    for n in (1, 30, 333, 4001):
        seen = Counter()

        class Watching(language_model.Network):
            def train_window(self, inputs, targets, fresh, h, weight):
                seen.update(targets[weight > 0].tolist())
                return super().train_window(inputs, targets, fresh, h, weight)

        document = np.array([*r.integers(1, lex.size, n), 0])
        network = Watching(language_model.Network.start(lex, np.ones(lex.size)), lex)
        assert language_model.train_shard(network, [document], 0.01) == n + 1
        assert seen == Counter(document.tolist())


def test_filling_leaves_gradients_alone():
    lex = language_model.lexicon([(b"w%d" % i, 50 - i) for i in range(40)], 10, ["ab", "cd"])
    r = np.random.default_rng(1)
    network = language_model.Network(language_model.Network.start(lex, np.ones(lex.size)), lex)
    inputs, targets = r.integers(1, lex.size, (5, 3)), r.integers(1, lex.size, (5, 3))
    start = r.standard_normal((3, language_model.HIDDEN)).astype(np.float32)
    whole, _ = network.train_window(inputs, targets, inputs == 0, start)
    padded = np.pad(inputs, ((0, 4), (0, 2))), np.pad(targets, ((0, 4), (0, 2)))
    weight = np.pad(np.ones((5, 3), dtype=np.float32), ((0, 4), (0, 2)))
    filled, _ = network.train_window(*padded, padded[0] == 0, np.pad(start, ((0, 2), (0, 0))), weight)
    for k, g in whole.items():
        assert np.allclose(filled[k], g, atol=1e-6), k


def test_learned_score_beats_counts_and_equals_a_plain_loop(spark):
    """Held-out documents of a table: better in the sum than word counts, and each score as a loop over words gives it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = {}
    kept = language_model.train

    def keep(training, lex, frequency, tokens, rounds=language_model.ROUNDS):
        made["lex"], made["p"] = lex, kept(training, lex, frequency, tokens, rounds)
        return made["p"]

    language_model.train = keep
    try:
        found = {x["doc_id"]: x for x in language_model.score(docs).collect()}
    finally:
        language_model.train = kept
    held = [x for x in found.values() if x["held_out"]]
    assert len(held) > 100
    assert sum(x["score"] for x in held) > 0.98 * sum(x["base_score"] for x in held)  # both are negative
    rows = docs.select("doc_id", "text").collect()
    lex, network = made["lex"], language_model.Network(made["p"], made["lex"])
    counts, held_words = Counter(), set(lex.words)
    for x in rows:
        if not found[x["doc_id"]]["held_out"]:
            counts.update(language_model.tokenize(x["text"]))
    mass, kinds = Counter(), Counter()
    for w, c in counts.items():
        if w not in held_words:
            mass[lex.other(w)] += c
            kinds[lex.other(w)] += 1
    for x in sorted(rows, key=lambda x: len(x["text"] or ""))[:25]:
        h, last, total = np.zeros((1, language_model.HIDDEN), dtype=np.float32), np.zeros(1, dtype=int), 0.0
        for w in [*language_model.tokenize(x["text"] or ""), None]:
            h = network.step(last, h)[0]
            last = np.array([0 if w is None else lex.code(w)])
            total += network.log_probabilities(h, last)[0] / np.log(10)
            if w is not None and w not in held_words:
                total += np.log10((counts[w] + 0.5) / (mass[last[0]] + 0.5 * (kinds[last[0]] + 1)))
        assert np.isclose(found[x["doc_id"]]["score"], total, rtol=1e-4, atol=1e-3)


def test_every_word_of_the_dictionary_has_an_output_and_is_an_input():
    """However many the words are: each has a class and a path of its own, and the probabilities of all add up to one."""
    words = [(b"w%da%d" % (i, i % 7), 20000 // (i + 1) + 1) for i in range(9000)]
    lex = language_model.lexicon(words, 10, ["a1", "a2"], [30, 20, 10])
    assert lex.size == 1 + 9000 + 2 + 1 and len(set(lex.words)) == 9000  # 500 had an output before
    assert [lex.code(w) for w, _ in words] == list(range(1, 9001)) and lex.code(b"xa2") == 9002 and lex.code(b"zz") == lex.rest
    paths = {(lex.of[s], *lex.turns[lex.starts[s] : lex.starts[s + 1]]) for s in range(lex.size)}
    assert len(paths) == lex.size
    assert len({lex.row[s] for s in range(lex.size)}) > 3000
    counts = np.array([10, *(c for _, c in words), 30, 20, 10], dtype=float)
    network = language_model.Network(language_model.Network.start(lex, counts), lex)
    h = np.random.default_rng(3).standard_normal((2, language_model.HIDDEN)).astype(np.float32)
    every = np.array([np.exp(network.log_probabilities(np.repeat(x[None], lex.size, axis=0), np.arange(lex.size))) for x in h])
    assert np.allclose(every.sum(axis=1), 1.0, atol=1e-4)
    assert np.abs(every[0] / every[1] - 1).min() > 0  # a state tells about each word, not only about some
    # Before anything is learned, words are as likely as they are frequent.
    network.p["w"][:], network.p["c"][:] = 0, 0
    assert np.allclose(np.exp(network.log_probabilities(np.repeat(h[:1], lex.size, axis=0), np.arange(lex.size))), (counts + 0.5) / (counts + 0.5).sum(), rtol=1e-3)


def test_gradients_of_nodes():
    lex = language_model.lexicon([(b"w%d" % i, 500 - i) for i in range(400)], 10, ["ab", "cd"])
    r = np.random.default_rng(5)
    network = language_model.Network(language_model.Network.start(lex, np.ones(lex.size)), lex)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    inputs, targets = r.integers(1, lex.size, (5, 30)), r.integers(0, lex.size, (5, 30))
    start = r.standard_normal((30, language_model.HIDDEN))

    def loss():
        h, found = start, 0.0
        for t in range(5):
            h = network.step(inputs[t], h)[0]
            found -= network.log_probabilities(h, targets[t]).sum() / targets.size
        return found

    grads, _ = network.train_window(inputs, targets, inputs == 0, start)
    for k, place in (*(("w", (int(i), int(j))) for i, j in r.integers(0, (lex.nodes, language_model.HIDDEN), (8, 2))), ("u", (1, 7)), ("x", (inputs[1, 2], 5))):
        network.p[k][place] += 1e-5
        up = loss()
        network.p[k][place] -= 2e-5
        slope = (up - loss()) / 2e-5
        network.p[k][place] += 1e-5
        assert abs(grads[k][place] - slope) < 1e-7 + 1e-3 * abs(slope), k
