"""Toxicity by a weighted lexicon: folded texts, Aho-Corasick, length, exception phrases.

Texts are folded first: case, homoglyphs, accents and digits that stand for letters.
The lexicon holds word beginnings, learned from a bounded sample of labelled rows:
each weighs the logarithm of how much likelier it is in toxic documents, if that
cannot be chance among as many candidates. Exception phrases are pairs of words
that hold a lexicon entry but are found in clean documents; matches inside them don't
count. The weight of all matches by the number of words gives the score.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolguard.llm.common import by_bytes, filter_rows, fold, labelled, map_arrow, texts_of
from toolguard.scale import materialize

THRESHOLD = 0.5
#: Documents that a model is fitted on at most: the bounded sample of labelled rows.
SAMPLE = 20_000
#: Lengths of word beginnings that can be entries; shorter and longer words can be entries as a whole.
SHORTEST, LONGEST = 4, 16
#: Bits that tell the words before a word beginning apart, and candidates by document.
BITS = 63
CANDIDATES = 100.0
#: Expected number of entries that get in by chance.
CHANCE = 0.1
#: Documents that an exception phrase must have been clean in.
CLEAN = 5

# Letters of other scripts, digits and signs that are read as Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "s", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}


class Folding(dict):
    """A table for ``str.translate`` that is filled as characters come up."""

    def __missing__(self, code: int) -> str:
        char = chr(code).lower()
        if char in HOMOGLYPHS:
            folded = HOMOGLYPHS[char]
        else:
            base = unicodedata.normalize("NFKD", char)
            folded = "".join(HOMOGLYPHS.get(x, x) for x in base if not unicodedata.combining(x))
            if unicodedata.category(char[0])[0] == "M" or unicodedata.category(char[0]) == "Cf":
                folded = ""  # accents and invisible characters inside words
            elif not folded.isalnum():
                folded = " "
        self[code] = folded
        return folded


def fold_text(text: str, table: Folding) -> str:
    """Folded words with one blank before and after each."""
    return f" {' '.join(text.translate(table).split())} "


@dataclass
class Model:
    """Entries start with a blank, so that they match at the beginning of words only."""

    lexicon: dict[str, float]
    exceptions: list[str]
    bias: float
    slope: float

    def matcher(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            automaton.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            automaton.add_word(phrase, (len(phrase), None))
        if len(automaton):
            automaton.make_automaton()
        return automaton

    def weigh(self, folded: str, automaton) -> float:
        """Sum over words of the largest weight that matches; words of exception phrases count nothing."""
        if not len(automaton):
            return 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []  # both ends of exception phrases
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if not spared:
            return sum(best.values())
        # Both in order: what lies before the farthest end so far is inside a phrase.
        spared.sort()
        total, reach, i = 0.0, -1, 0
        for at in sorted(best):
            while i < len(spared) and spared[i][0] <= at:
                reach, i = max(reach, spared[i][1]), i + 1
            if at >= reach:
                total += best[at]
        return total

    def score(self, weight: float, words: int) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.bias + self.slope * density(weight, words)))))


def density(weight: float, words: int) -> float:
    """Weight by length, as a logarithm: 0 for no match."""
    return math.log1p(1000.0 * weight / max(words, 1))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: in how many documents of each label a word beginning is, and after which words.

    The words before it go into a map of 64 bits, which merges by OR.
    """
    table = Folding()
    for batch in by_bytes(batches, "text"):
        found: dict[str, list[int]] = {}
        for text, label in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
            words = fold_text(text, table).split()
            before = dict(zip(words, ["", *words], strict=False))
            seen: dict[str, int] = {}
            for word, last in before.items():
                bit = 1 << (zlib.crc32(last.encode()) % BITS)
                entries = [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]
                if not SHORTEST <= len(word) <= LONGEST:
                    entries.append(f"{word} ")  # with the blank behind it
                for entry in entries:
                    seen[entry] = seen.get(entry, 0) | bit
            for term, bits in seen.items():
                row = found.setdefault(term, [0, 0, 0])
                row[label != 1] += 1
                if label == 1:
                    row[2] |= bits
        columns = [[row[i] for row in found.values()] for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["term", "toxic", "clean", "contexts"]
        )


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Word beginnings of (text, label) that mark toxic documents, with their weights.

    Copies of a document or passage say the same thing once: a beginning counts for as
    many toxic documents as it has different words before it, estimated from the bits.
    """
    if not n_toxic or not n_clean:
        return {}
    terms = map_arrow(sample.select("text", "label"), _terms, "term string, toxic long, clean long, contexts long")
    terms = terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("contexts").alias("contexts"))
    empty = (BITS - F.bit_count("contexts")) / F.lit(float(BITS))
    different = F.when(empty > 0, -BITS * F.log(empty)).otherwise(F.lit(1e9))
    toxic, clean = F.least(F.col("toxic").cast("double"), different), F.col("clean")
    rate = n_toxic / (n_toxic + n_clean)
    # Chernoff's bound of a chance excess: n * KL(share, rate), against all candidates.
    share = toxic / (toxic + clean)
    excess = (toxic + clean) * (
        share * F.log(share / F.lit(rate)) + F.when(share < 1, (1 - share) * F.log((1 - share) / F.lit(1 - rate))).otherwise(0.0)
    )
    needed = math.log(CANDIDATES * (n_toxic + n_clean) / CHANCE)
    weight = F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0))
    found = terms.where((toxic > 1) & (share > 0.5) & (excess > needed)).select("term", weight.alias("weight")).collect()
    lexicon: dict[str, float] = {}
    for term, value in sorted((r["term"], r["weight"]) for r in found):
        # An entry that says no more than a shorter one is not needed.
        if not any(lexicon.get(" " + term[:n], -1.0) >= value - 1.0 for n in range(SHORTEST, len(term))):
            lexicon[" " + term] = value
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, column: str = "toxic", exceptions: tuple[str, ...] = ()) -> Model:
    """Learn from at most about ``sample_size`` labelled documents outside the held-out fold.

    ``exceptions`` are further phrases in which no match counts. Without both labels the model scores 0.
    """
    sample = labelled(docs, labels, column, sample_size, seed=8)
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), sum(n for x, n in counts.items() if x != 1)
    lexicon = learn_lexicon(sample, n_toxic, n_clean)
    table = Folding()
    given = [fold_text(x, table).rstrip() for x in exceptions]
    model = Model(lexicon, given, 0.0, 0.0)
    if not lexicon:
        return Model({}, given, -20.0, 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, folding = model.matcher(), Folding()
        for batch in by_bytes(batches, "text"):
            rows = []
            for text, label in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
                folded = fold_text(text, folding)
                weight = model.weigh(folded, matcher)
                phrases: set[str] = set()
                if weight:
                    words = folded.split()
                    for a, b in zip(words, words[1:], strict=False):
                        pair = f" {a} {b} "  # with the blank after it, so that no longer word is spared
                        if any(length and value for _, (length, value) in matcher.iter(pair)):
                            phrases.add(pair)
                rows.append((label, weight, len(folded.split()), sorted(phrases)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.string())), strict=True)],
                ["label", "weight", "words", "phrases"],
            )

    measured = map_arrow(sample.select("text", "label"), measure, "label int, weight double, words long, phrases array<string>")
    measured = materialize(measured)
    phrases = measured.select("label", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("clean")
    )
    model.exceptions += sorted(r["phrase"] for r in phrases.where((F.col("clean") >= CLEAN) & (F.col("clean") > 20 * F.col("toxic"))).collect())
    # The sample is bounded, and so is what comes of it: three numbers a document.
    rows = measured.select("label", "weight", "words").collect()
    x = np.array([density(r["weight"], r["words"]) for r in rows])
    model.bias, model.slope = _logistic(x, np.array([float(r["label"] == 1) for r in rows]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Bias and slope by Newton's method; both classes weigh the same."""
    design = np.column_stack([np.ones_like(x), x])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    theta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, texts whole."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, folding = model.matcher(), Folding()
        for batch in by_bytes(batches, "text"):
            found = []
            for text in texts_of(batch):
                folded = fold_text(text, folding)
                found.append(model.score(model.weigh(folded, matcher), len(folded.split())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], "score"])

    return map_arrow(docs.select("doc_id", "text"), scores, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text; other columns are ignored).

    NULL and empty texts score as texts without a match. A NULL id is never held out.
    Repeated rows come back as often as they are there; an empty table gives no rows;
    without labels of both kinds every score is about 0.
    """
    return score(docs, fit(docs, labels, sample_size)).select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; all columns and repeats kept."""
    model = fit(docs, labels, sample_size)
    return filter_rows(docs, lambda: _judge(model, threshold))


def _judge(model: Model, threshold: float):
    matcher, folding = model.matcher(), Folding()

    def clean(text: str) -> bool:
        folded = fold_text(text, folding)
        return model.score(model.weigh(folded, matcher), len(folded.split())) < threshold

    return lambda texts: list(map(clean, texts))
