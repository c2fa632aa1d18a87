"""Text quality by nearest-neighbour voting among latent-semantic vectors.

A text has terms of two kinds: its words and pairs of words; and its form, the shapes of its
words (letters by case, digits, signs, runs cut short) and how much it repeats words and
lines. Each kind is hashed into a fixed space without leaving terms out. On a bounded sample of
labelled rows they get weights by inverse document frequency and a singular value
decomposition each. Latent vectors of both kinds make up one vector; how much words count in it
is what the sample's own labels are best told by, each document from the others. The
sample's vectors are broadcast; each task multiplies its documents' vectors with all of them,
block by block, in exact cosines, and the nearest ones vote with their similarity.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolguard.llm.common import by_bytes, filter_rows, fold, labelled, map_arrow, texts_of

THRESHOLD = 0.3
#: Labelled rows that vote at most, in the expectation: the bounded sample, and what is broadcast.
SAMPLE = 6_000
#: Places of hashed terms of form and of words, and latent dimensions of each.
FORMS, WORDS = 1024, 1024
DIMENSIONS = 48
#: Shares of words in a vector that are tried, as cosines add up, the mean squared error that counts as
#: no worse, and documents of the sample on which they are tried at most.
SHARES = (0.0, 0.1, 0.25, 0.5, 0.75)
NO_WORSE = 0.002
TRIED = 1_500
#: Documents whose cosines with the whole sample the driver holds at a time.
TRIED_BLOCK = 256
NEIGHBOURS = 15
#: Documents and labelled vectors in one product.
BLOCK = 1024


class Shapes(dict):
    """A table for ``str.translate``: a, A, 0, white space, or the sign itself."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char.isspace():
            shape = char if char in " \n" else " "
        elif char.isalpha():
            shape = "A" if char.isupper() else "a"
        else:
            shape = "0" if char.isdigit() else char
        self[code] = shape
        return shape


def shorten_runs(text: str) -> str:
    """Runs of one character, white space aside, as that character once."""
    for char in sorted(set(text) - {" ", "\n"}):
        twice = char + char
        while twice in text:
            text = text.replace(twice, char)
    return text


def terms(text: str, table: Shapes) -> dict[str, float]:
    """Term counts of a whole text."""
    words = text.split()
    if not words:
        return {}
    found = Counter(shorten_runs(text.translate(table)).split())
    n = len(words)
    counts = {f"shape {x}": float(c) for x, c in found.items()}
    same = sum(map(str.__eq__, words, words[1:]))
    if same:
        counts["repeats word"] = float(same)
    lines = [x for x in text.split("\n") if x]
    if len(lines) > 1 and (again := len(lines) - len(set(lines))):
        counts["repeats line"] = n * again / len(lines)
    counts["repeats any"] = float(max(n - len(set(words)) - n / 2, 0))
    return counts


class Hashes(dict):
    """Hashes of terms; remembers a bounded number of them."""

    MOST = 1 << 17

    def __missing__(self, term: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[term] = xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"), 3)
        return found

    def of(self, terms) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, terms), dtype=np.uint64, count=len(terms))


class Reader:
    """Rows of both hashed spaces of texts."""

    def __init__(self, with_words: bool = True):
        self.shapes, self.hashes, self.with_words = Shapes(), Hashes(), with_words

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        form, word = np.zeros((len(texts), FORMS), dtype=np.float32), np.zeros((len(texts), WORDS), dtype=np.float32)
        for i, text in enumerate(texts):
            counts = terms(text, self.shapes)
            place(form[i], self.hashes.of(counts), np.fromiter(counts.values(), dtype=float, count=len(counts)))
            words = self.hashes.of(text.lower().split() if self.with_words else ())
            if len(words):
                pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
                place(word[i], *np.unique(np.concatenate([words, pairs]), return_counts=True))
        return form, word


def place(row: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
    """Add terms to their places, with signs so that those that share one don't only add up."""
    if len(hashes):
        sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
        # Shares on a logarithmic scale: the length of a text says nothing.
        np.add.at(row, (hashes >> np.uint64(20)) % np.uint64(len(row)), sign * np.log1p(100.0 * counts / counts.sum()))


@dataclass
class Model:
    weights: list[np.ndarray]
    projections: list[np.ndarray]
    share: float
    vectors: np.ndarray
    votes: np.ndarray
    prior: float

    def parts(self, rows: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Latent unit vectors of form and of words."""
        return [unit((x * w) @ p) for x, w, p in zip(rows, self.weights, self.projections, strict=True)]

    def vector(self, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        form, word = self.parts(rows)
        return unit(np.concatenate([form * math.sqrt(1 - self.share), word * math.sqrt(self.share)], axis=1))

    def score(self, texts: list[str], reader: Reader) -> list[float]:
        """Similarity-weighted votes; the sample's share of label 1 where nothing is similar."""
        scores: list[float] = []
        for start in range(0, len(texts), BLOCK):
            x = self.vector(reader.rows(texts[start : start + BLOCK]))
            k = min(NEIGHBOURS, len(self.vectors))
            near = np.full((len(x), k), -2.0, dtype=np.float32)
            vote = np.zeros((len(x), k), dtype=np.float32)
            for first in range(0, len(self.vectors), BLOCK):
                cosines = x @ self.vectors[first : first + BLOCK].T
                both = np.concatenate([near, cosines], axis=1)
                votes = np.concatenate([vote, np.broadcast_to(self.votes[first : first + BLOCK], cosines.shape)], axis=1)
                # Equal cosines keep the order of the sample, so ties are settled alike everywhere.
                top = np.argsort(-both, axis=1, kind="stable")[:, :k] if k else np.zeros((len(x), 0), dtype=int)
                near, vote = np.take_along_axis(both, top, axis=1), np.take_along_axis(votes, top, axis=1)
            scores += voted(near, vote, self.prior).tolist()
        return scores


def voted(near: np.ndarray, vote: np.ndarray, prior: float) -> np.ndarray:
    weight = np.maximum(near, 0.0).astype(np.float64) ** 4
    total = weight.sum(axis=1)
    shares = (weight * vote).sum(axis=1) / np.where(total > 0, total, 1.0)
    return np.where(total > 0, shares, prior).clip(0.0, 1.0)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1.0)).astype(np.float32)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of both spaces of the sample's texts, one after the other as bytes, and a hash of the text."""
    reader = Reader()
    for batch in by_bytes(batches, "text"):
        texts = list(texts_of(batch))
        keys = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in texts]
        both = [row.astype("<f2").tobytes() for row in np.concatenate(reader.rows(texts), axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(both, pa.binary())], ["doc_id", "label", "key", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, column: str = "quality") -> Model:
    """Learn from at most about ``sample_size`` labelled documents outside the held-out fold."""
    sample = labelled(docs, labels, column, sample_size, seed=2).select("doc_id", "label", "text")
    # Bounded: four KB for each document of the sample.
    rows = map_arrow(sample, _hashed, "doc_id bigint, label int, key bigint, x binary").toArrow().sort_by([("doc_id", "ascending"), ("key", "ascending")])
    votes = np.array([float(y == 1) for y in rows["label"].to_pylist()], dtype=np.float32)
    prior = float(votes.mean()) if len(votes) else 0.5
    x = np.empty((len(votes), FORMS + WORDS), dtype=np.float32)
    for i, v in enumerate(rows["x"]):  # without further copies of all rows, as the driver's memory is short
        x[i] = np.frombuffer(v.as_buffer(), dtype="<f2")
    del rows
    spaces = [x[:, :FORMS], x[:, FORMS:]]
    often = [(x != 0).sum(axis=0) for x in spaces]
    weights = [np.log(1.0 + (1 + len(votes)) / (1 + n)).astype(np.float32) for n in often]
    projections = [singular(x * w) for x, w in zip(spaces, weights, strict=True)]
    model = Model(weights, projections, 0.0, np.zeros((0, 2 * DIMENSIONS), np.float32), votes[:0], prior)
    if not len(votes):
        return model
    model.share = best_share(*model.parts(tuple(spaces)), votes, prior)
    latent = model.vector(tuple(spaces))
    filled = np.abs(latent).sum(axis=1) > 0
    model.vectors, model.votes = latent[filled], votes[filled]
    return model


def singular(x: np.ndarray, rounds: int = 5, seed: int = 4) -> np.ndarray:
    """Leading right singular vectors as columns, by subspace iteration from seeded starts."""
    found = np.zeros((x.shape[1], DIMENSIONS), dtype=np.float32)
    if not x.any():
        return found
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], min(DIMENSIONS + 16, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    small = (x @ basis).astype(np.float64)
    values, turn = np.linalg.eigh(small.T @ small)
    keep = [i for i in np.argsort(-values)[:DIMENSIONS] if values[i] > 1e-6 * values.max()]
    found[:, : len(keep)] = basis @ turn[:, keep]
    return found


def best_share(form: np.ndarray, word: np.ndarray, votes: np.ndarray, prior: float) -> float:
    """The smallest share of words by which documents of the sample are told from the others about as well as by any."""
    errors = np.zeros(len(SHARES))
    k = min(NEIGHBOURS, len(votes) - 1)
    if k < 1:
        return SHARES[0]
    tried = np.unique(np.linspace(0, len(votes) - 1, TRIED).astype(int))
    for start in range(0, len(tried), TRIED_BLOCK):
        rows = tried[start : start + TRIED_BLOCK]
        cosines = form[rows] @ form.T, word[rows] @ word.T
        for i, share in enumerate(SHARES):
            both = (1 - share) * cosines[0] + share * cosines[1]
            both[np.arange(len(rows)), rows] = -2.0
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            found = voted(np.take_along_axis(both, top, axis=1), votes[top], prior)
            errors[i] += np.square(found - votes[rows]).sum()
    errors /= len(tried)
    return SHARES[int(np.flatnonzero(errors <= errors.min() + NO_WORSE)[0])]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, texts whole."""

    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(**shared.value)
        reader = Reader(held.share > 0)
        for batch in by_bytes(batches, "text"):
            found = held.score(list(texts_of(batch)), reader)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), scores, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text; other columns are ignored).

    NULL and empty texts have no vector and get the share of label 1 in the sample, 0.5
    without labels. A NULL id is never held out. Repeated rows come back as often as
    they are there; an empty table gives no rows.
    """
    return score(docs, fit(docs, labels, sample_size)).select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``; all columns and repeats kept."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(fit(docs, labels, sample_size)))

    def judge():
        model = Model(**shared.value)
        reader = Reader(model.share > 0)
        return lambda texts: [s >= threshold for s in model.score(texts, reader)]

    return filter_rows(docs, judge)
