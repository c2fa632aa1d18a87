"""Personal data, periodic runs and whitening against plain versions, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from helpers import awkward, empty, sentences
from toolguard.llm import periodic, personal, queries, whitening

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def plain_base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            valid = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15,
            }
            if valid[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def noise(n):
    r = random.Random(4)
    parts = [
        "a@b.c", "@", ".", "x", "a.b", "%", " ", "+", "1", "12.3.4.5", "256", "4465758382889437", "4242 4242 4242 4242", "é", "🙂", "+1 (743) 555-3824",
        "-", "(", "b-", "..", "\n", "0000010.1.1.1", "4-2-4-2-4-2-4-2-4-2-4-2-4-2-4-2", "9" * 40, "a" * 30,
    ]
    return ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(n)]


def test_personal_data_base_spans_and_rows(spark, monkeypatch):
    frame, rows = awkward(spark, [(1000 + i, t, "en", "s", 1) for i, t in enumerate(noise(1500))])
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    got = queries.op11_personal_data(spark, "").collect()
    want = Counter()
    for i, text, *_ in rows:
        base = plain_base(text)
        counts = Counter(k for k, _, _ in base)
        want[i, *(counts[k] for k in personal.KINDS), sha(joined(base))] += 1
    assert Counter((x["doc_id"], x["n_email"], x["n_ip"], x["n_card"], x["n_phone"], x["base_sha256"]) for x in got) == want
    text_of = {i: t or "" for i, t, *_ in rows if i is not None and i >= 1000}
    order = {k: i for i, k in enumerate(personal.KINDS)}
    for x in got:
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in x["spans"].split(",") if s]
        assert spans == sorted(spans, key=lambda s: (order[s[0]], s[1]))
        if x["doc_id"] in text_of:
            text = text_of[x["doc_id"]]
            base = plain_base(text)
            assert set(base) <= set(spans)
            for kind, a, b in set(spans) - set(base):  # added ones overlap nothing
                assert 0 <= a < b <= len(text)
                assert all(b <= c or d <= a for k, c, d in spans if (k, c, d) != (kind, a, b))
    monkeypatch.setattr(queries, "table", lambda *_: empty(spark))
    assert queries.op11_personal_data(spark, "").count() == 0


def test_personal_data_method_finds_what_base_patterns_miss(spark):
    r, texts = random.Random(8), sentences(400, seed=31)
    card = lambda: "4" + "".join(r.choices("0123456789", k=14))
    rows, wanted = [], {}
    for i, text in enumerate(texts):
        number = card()
        number += next(d for d in "0123456789" if plain_luhn(number + d))
        phone = f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
        mail = f"name{i}@host.example.com"
        words = text.split()
        at = r.randrange(len(words) + 1)
        if i % 8 == 0:  # one after the other, which the base patterns take for one long number
            words[at:at] = [phone, number]
            wanted[i] = {("card", number), ("phone", phone)}
        elif i % 8 == 1:
            words[at:at] = ["write", "to", f"name{i} (at) example (dot) com"]
            wanted[i] = {("email", f"name{i} (at) example (dot) com")}
        else:
            words[at:at] = [r.choice([phone, number, mail, f"{r.randrange(1, 99)}.{r.randrange(99)}.7.{r.randrange(99)}"])]
            if i % 8 == 2:
                words.insert(0, f"order no. {card()[:13]}")
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: {(s["kind"], rows[x["doc_id"]][1][s["start"] : s["end"]]) for s in x["spans"] if not s["base"]} for x in personal.spans(docs).collect()}
    assert sum(found[i] == w for i, w in wanted.items()) >= 0.95 * len(wanted)
    assert sum(bool(f) for i, f in found.items() if i not in wanted) <= 0.02 * len(rows)


def test_reliabilities_tell_a_labeler_that_guesses(spark):
    r, counts = random.Random(2), Counter()
    for _ in range(4000):
        truth = 1 if r.random() < 0.4 else -1
        right = lambda p: truth if r.random() < p else -truth  # noqa: E731, B023
        counts[(right(0.95), right(0.9), right(0.9), 0, right(0.5), right(0.8))] += 1
    frame = spark.createDataFrame([(0, list(v), n) for v, n in counts.items()], "k int, votes array<int>, n long")
    _, weights = personal.reliabilities(frame)
    strength = [table[2] - table[0] for table in weights[0]]
    assert strength[0] > strength[1] > strength[5] > 1 > abs(strength[4])
    assert strength[0] > 2 * np.log(0.9 / 0.1)


def test_personal_data_of_long_texts(spark):
    # Each of these takes quadratic time with the patterns as they are written in the contract.
    texts = ["a" * 300_000, "1" * 300_000, "+1" + " " * 300_000, "1." * 100_000, "a@" + "b" * 300_000, "a@b.c " * 20_000, "@" * 100_000, "a@b" + ".c" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x["doc_id"]: x["spans"] for x in personal.spans(docs).collect()}
    assert [len(got[i]) for i in range(8)] == [0, 0, 0, 25_000, 0, 20_000, 0, 1]
    assert (got[7][0]["start"], got[7][0]["end"]) == (0, len(texts[7]))


def plain_runs(words, least=24, times=3):
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                part = words[i : j + q]
                if not any(part[:-p] == part[p:] for p in range(1, q)):
                    found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_op12(doc_id, text):
    words = SPLIT.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def repetitive(n):
    r, texts = random.Random(6), []
    for _ in range(n):
        words = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 8])]) for _ in range(r.randrange(90))]
        for _ in range(r.randrange(3)):
            block = [r.choice("abcdexyzé") for _ in range(r.randrange(1, 14))]
            at = r.randrange(len(words) + 1)
            words[at:at] = (block * r.randrange(2, 9))[: r.randrange(20, 80)]
        texts.append(r.choice([" ", "\n", " \t"]).join(words))
    return texts


def test_periodic_runs(spark, monkeypatch):
    frame, rows = awkward(spark, [(1000 + i, t, "en", "s", 1) for i, t in enumerate(repetitive(500))])
    rows = [r for r in rows if r[0] != 105]  # the plain version is too slow for a long text; see below
    frame = frame.where("doc_id is null or doc_id <> 105")
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = Counter(tuple(x[c] for c in columns) for x in queries.op12_periodic_runs(spark, "").collect())
    want = Counter(plain_op12(r[0], r[1]) for r in rows)
    assert got == want
    assert sum(x[1] > 1 for x in got) > 30
    monkeypatch.setattr(queries, "table", lambda *_: empty(spark))
    assert queries.op12_periodic_runs(spark, "").count() == 0


def test_catcher_takes_words_in_portions_of_any_size():
    r = random.Random(3)
    for text in repetitive(300):
        words = text.split()
        ids = {w: i for i, w in enumerate(sorted(set(words)))}
        catcher, at = periodic.SquareCatcher(), 0
        while at < len(words):
            size = r.choice([1, 1, 2, 5, 40])
            catcher.append(np.array([ids[w] for w in words[at : at + size]]))
            at += size
        assert catcher.runs() == plain_runs(words)


def test_catcher_does_not_rest_on_names(monkeypatch):
    # Names of four values only: nearly all that agree do so by chance.
    monkeypatch.setattr(periodic, "_mix", lambda x, mix=periodic._mix: mix(x) % np.uint64(4096))
    for text in repetitive(150):
        words = text.split()
        ids = {w: i for i, w in enumerate(sorted(set(words)))}
        catcher = periodic.SquareCatcher()
        catcher.append(np.array([ids[w] for w in words], dtype=np.int64))
        assert catcher.runs() == plain_runs(words)


def test_long_runs_of_several_periods():
    catcher = periodic.SquareCatcher()
    inner = [0] * 50 + [1] * 50 + list(range(2, 900))
    words = np.array(inner * 100 + [5000] * 20_000 + list(range(6000, 6100)))
    catcher.append(words)
    n = len(inner)
    want = [(n * i, 50, 1) for i in range(100)] + [(n * i + 50, 50, 1) for i in range(100)] + [(0, 100 * n, n), (100 * n, 20_000, 1)]
    assert catcher.runs() == sorted(want, key=lambda r: (r[0], r[2]))


def test_inertia_and_leading_eigenvectors():
    r = np.random.default_rng(0)
    for i in range(150):
        d = int(r.integers(1, 24))
        q, _ = np.linalg.qr(r.standard_normal((d, d)))
        values = np.abs(r.standard_normal(d)) * 10.0 ** r.integers(-4, 4)
        if i % 3 == 0:
            values[: d // 2] = values[0]  # equal ones
        if i % 4 == 0:
            values[d // 2 :] = 0
        if i % 5 == 0:
            values = 1 + 1e-9 * r.standard_normal(d)  # nearly equal ones
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        for shift in r.standard_normal(3):
            assert whitening.inertia(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
        got, vectors = whitening.leading(a)
        assert len(got) == min(16, (values > 1e-10 * values.sum()).sum())
        assert np.allclose(got, np.linalg.eigvalsh(a)[::-1][: len(got)], rtol=1e-9, atol=1e-12 * values.max())
        assert np.allclose(vectors @ vectors.T, np.eye(len(got)), atol=1e-12)
        assert not len(got) or np.abs(vectors @ a - got[:, None] * vectors).max() < 1e-12 * values.max()


def plain_whitening(rows, width):
    usable = [(i, [float(v) for v in x]) for i, x in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    whole = [(i, [int(np.floor(64 * v)) + 1_000_000 for v in x] + [1_000_000] * (width - len(x))) for i, x in usable]
    fit = np.array(sorted({tuple(x) for _, x in whole}))
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    spread = y.T @ y / n
    values, vectors = np.linalg.eigh(spread)
    order = np.argsort(-values)[:16]
    return whole, n, sums, values[order], vectors[:, order], np.trace(spread)


def test_whitening(spark):
    r = np.random.default_rng(5)
    made = (r.standard_normal((400, 20)) * (1 + np.arange(20))[::-1] + 300).tolist()
    rows = list(enumerate(made)) + [(3, made[3]), (900, made[4]), (None, made[5]), (901, None), (902, [1.0, None] * 10), (903, [float("nan")] * 20)]
    rows += [(904, [float("inf")] * 20), (905, made[6][:7]), (906, [])]
    frame = spark.createDataFrame([(i, x, 1, 2.0) for i, x in rows], "vec_id long, embedding array<double>, component int, whitened double")
    got = whitening.whiten(frame).collect()
    whole, n, sums, values, vectors, trace = plain_whitening(rows, 20)
    assert Counter(x["vec_id"] for x in got) == Counter({i: 16 * k for i, k in Counter(i for i, _ in whole).items()})
    deviations = Counter()
    for i, x in whole:
        deviations[i, sum((n * v - int(s)) ** 2 for v, s in zip(x, sums))] += 16
    assert Counter((x["vec_id"], x["deviation"]) for x in got) == deviations
    by_id = {i: np.array(x) for i, x in whole}
    signs = {}
    for x in got:
        k = x["component"] - 1
        want = (by_id[x["vec_id"]] - sums / n) @ vectors[:, k] / np.sqrt(values[k])
        sign = signs.setdefault(k, np.sign(want * x["whitened"]))
        assert x["whitened"] == pytest.approx(sign * want, abs=1e-8)
        assert x["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
        assert x["n"] == n and 0 <= x["identity_error"] < 1e-8


def test_whitening_of_nothing_and_of_wide_numbers(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], kind)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1e300, 2.0], 1), (2, [-1e300, 5.0], 1), (3, [0.0, 1.0], None)], kind)).collect()
    assert {(x["vec_id"], x["component"]) for x in got} == {(i, 1) for i in (1, 2, 3)}
    assert {x["deviation"] is None for x in got if x["vec_id"] != 3} == {True}
