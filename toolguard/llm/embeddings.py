"""Near copies among embeddings of one label, found by an inverted multi-index.

Two independent codebooks, one for each half of the vectors, span a grid of cells. Each
vector lies in one cell and visits the nearest ones in the order of the multi-sequence
algorithm: by the sum of both halves' distances. How many it visits comes from the bounded
sample that the codebooks are trained on: so many that pairs at the very threshold meet with
the target recall. Cells are cut into blocks of bounded size, and all cosines of a block are
computed exactly in double precision. A block returns counts and a spanning forest of its
links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolguard.llm.common import bounded_sample, map_arrow, shipped
from toolguard.llm.components import components
from toolguard.scale import materialize

THRESHOLD = 0.93
#: Vectors that the codebooks are trained on at most, in the expectation.
SAMPLE = 20_000
#: Share of pairs at the threshold that are to meet in some cell.
RECALL = 0.995
#: Vectors of the largest label that a cell holds on average, codewords of a half at most, vectors in a block's side.
CELL = 500
CODEWORDS = 256
BLOCK = 1024
#: Cosines that are looked at in one step.
STEP = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Codewords by Lloyd's algorithm, from distinct starts."""
    starts = np.unique(x, axis=0)
    random = np.random.default_rng(seed)
    words = starts[random.permutation(len(starts))[:k]].copy()
    for _ in range(rounds):
        near = distances(x, words).argmin(axis=1)
        counts = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ words.T + (words**2).sum(axis=1), 0.0)


class Index:
    """Codebooks of both halves and the number of cells that are visited."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int):
        self.first, self.second, self.visits = first, second, visits

    def traversal(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first.

        Of sorted distances, the pair (i, j) has (i+1)(j+1)-1 others before it at least, so
        the nearest ``visits`` cells are among the pairs whose product is no larger.
        """
        half = self.first.shape[1]
        d1, d2 = distances(x[:, :half], self.first), distances(x[:, half:], self.second)
        o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        pairs = [(i, j) for i in range(min(len(self.first), visits)) for j in range(min(len(self.second), visits // (i + 1)))]
        i, j = np.array(pairs).T
        sums = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
        order = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(o1[:, i] * len(self.second) + o2[:, j], order, 1)

    @staticmethod
    def fit(sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = 7) -> Index:
        """Train on unit vectors, and visit so many cells that ``recall`` of the pairs at ``threshold`` meet."""
        half = sample.shape[1] // 2
        index = Index(kmeans(sample[:, :half], k), kmeans(sample[:, half:], k), 1)
        # A pair at the threshold: a vector turned by that angle in a random direction.
        random = np.random.default_rng(seed)
        x = sample[random.permutation(len(sample))[:2000]]
        turn = random.standard_normal(x.shape)
        turn -= (turn * x).sum(axis=1, keepdims=True) * x
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * turn
        cells = len(index.first) * len(index.second)
        a, b = index.traversal(x, cells), index.traversal(y, cells)
        # Either may visit the other's cell.
        rank = np.minimum((a == b[:, :1]).argmax(axis=1), (b == a[:, :1]).argmax(axis=1))
        index.visits = int(np.sort(rank)[min(len(rank) - 1, math.ceil(recall * len(rank)))]) + 1
        return index


def unpack(column, width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column), dtype="<f8").reshape(-1, width)
    scale = np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.asarray(v.as_py(), dtype="<f8").tobytes() for v in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "vector"])


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(node, label, width, k1, k2, vector, times, first): each different vector of a label once."""
    usable = rows.where("usable").groupBy("label", "width", "k1", "k2").agg(
        F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("first"), F.first("embedding").alias("embedding")
    )
    packed = map_arrow(
        usable.select("label", "width", "k1", "k2", "times", "first", "embedding"), _pack,
        "label string, width int, k1 long, k2 long, times long, first long, vector binary",
    )
    # The table is written at once, which settles the ids.
    return materialize(packed.withColumn("node", F.monotonically_increasing_id()))


def identified(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, usable, width, k1, k2); labels of any type are compared by their text; unusable vectors have none, or are NULL, zero or not finite."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), x.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0.0), F.lit(False))
    return rows.withColumn("usable", usable).select(
        "*", F.size("embedding").alias("width"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(5), "embedding").alias("k2")
    )


def _block_links(rows: pd.DataFrame, width: int, threshold: float) -> tuple[pd.DataFrame, int]:
    """Counts and a spanning forest of the links between visitors and residents of one block."""
    visitors, residents = rows[~rows["resident"]], rows[rows["resident"]]
    empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
    if visitors.empty or residents.empty:
        return empty, 0
    q, r = unpack(visitors["vector"], width), unpack(residents["vector"], width)
    qn, rn = visitors["node"].to_numpy(), residents["node"].to_numpy()
    qt, rt = visitors["times"].to_numpy(), residents["times"].to_numpy()
    qc, cell = visitors["home"].to_numpy(), residents["home"].to_numpy()[0]
    away = np.array(residents["visits"].tolist())  # the cells that each resident visits itself
    nodes, place = np.unique(np.concatenate([qn, rn]), return_inverse=True)
    qi, ri = place[: len(qn)], place[len(qn) :]
    counts, label = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    parts = []
    for start in range(0, len(q), STEP):
        i, j = np.nonzero(q[start : start + STEP] @ r.T >= threshold)
        i += start
        # A pair that meets twice counts where the smaller node is the visitor.
        keep = qn[i] < rn[j]
        other = (qn[i] > rn[j]) & (qc[i] != cell)
        if other.any():
            x, y = i[other], j[other]
            meets = np.zeros(len(x), dtype=bool)
            for column in away.T:  # column by column: no large table of comparisons
                meets |= column[y] == qc[x]
            keep[np.flatnonzero(other)[~meets]] = True
        i, j = i[keep], j[keep]
        np.add.at(counts, qi[i], rt[j])
        np.add.at(counts, ri[j], qt[i])
        parts.append((qi[i], ri[j]))
        _join(label, qi[i], ri[j])
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    before = None
    while before is None or (before != label).any():  # until the steps' forests agree
        before = label.copy()
        _join(label, u, v)
    linked = np.flatnonzero(counts)
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    found = pd.DataFrame({
        "a": np.concatenate([nodes[linked], nodes[tied]]), "b": np.concatenate([np.full(len(linked), -1), nodes[label[tied]]]),
        "n": np.concatenate([counts[linked], np.zeros(len(tied), dtype=np.int64)]),
    })
    return found, len(u)


def _join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Lower the labels of linked nodes to the smaller one, and follow labels to their own."""
    if len(u):
        low = np.minimum(label[u], label[v])
        for at in (label[u], label[v], u, v):
            np.minimum.at(label, at, low)
        while (label != label[label]).any():
            label[:] = label[label]


def links(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample_size: int = SAMPLE) -> DataFrame:
    """(a, b, n): ``n`` links of node ``a`` (b is -1), or that ``a`` and ``b`` are connected (n is 0)."""
    parts = [_links_of(nodes.where(F.col("width") == w), w, threshold, recall, sample_size)
             for w in sorted(r["width"] for r in nodes.select("width").distinct().collect())]
    found = nodes.sparkSession.createDataFrame([], "a long, b long, n long")
    for part in parts:
        found = found.unionByName(part)
    return found


def _links_of(nodes: DataFrame, width: int, threshold: float, recall: float, sample_size: int) -> DataFrame:
    chosen = bounded_sample(nodes.select("node", "vector"), "node", sample_size, seed=5).orderBy("node").collect()
    sample = unpack([r["vector"] for r in chosen], width)
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0]
    k = int(min(CODEWORDS, max(1, math.isqrt(largest // CELL)), len(sample)))
    index = Index.fit(sample, k, threshold, recall)
    first, second, visits = index.first, index.second, index.visits

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Index(first, second, visits)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                cells = held.traversal(unpack(part.column(2).to_pylist(), width), visits).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cells[:, 0].tolist(), pa.int32()), pa.array(cells.tolist(), pa.list_(pa.int32()))],
                    [*part.schema.names, "home", "visits"],
                )

    placed = materialize(map_arrow(
        nodes.select("node", "label", "vector", "times"), visit, "node long, label string, vector binary, times long, home int, visits array<int>"
    ))
    visiting = placed.select("node", "label", "vector", "times", "home", F.explode("visits").alias("cell"))
    # One row a cell of the grid and label: how its two sides are cut into blocks.
    sides = visiting.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("nv")).join(
        placed.groupBy("label", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("nr")), ["label", "cell"]
    )
    cuts = materialize(sides.select("label", "cell", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("nv", "nr"))))
    none = F.array().cast("array<int>")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    left = visiting.join(cuts, ["label", "cell"]).select(
        "label", "cell", own("nv").alias("bv"), F.explode(every("nr")).alias("br"), F.lit(False).alias("resident"), "node", "times", "home", none.alias("visits"), "vector"
    )
    right = placed.withColumn("cell", F.col("home")).join(cuts, ["label", "cell"]).select(
        "label", "cell", F.explode(every("nv")).alias("bv"), own("nr").alias("br"), F.lit(True).alias("resident"), "node", "times", "home", "visits", "vector"
    )

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        return _block_links(rows, width, threshold)[0]

    with shipped():
        return left.unionByName(right).groupBy("label", "cell", "bv", "br").applyInPandas(block, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample_size: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label; other columns are ignored).

    Vectors link if their labels and widths are equal and their cosine is ``threshold`` or more.
    Vectors without a label, or that are NULL, empty, zero or hold NULL or non-finite numbers link with
    nothing: 0 links, their own id, kept. Repeated rows are vectors of their own and link with each other.
    A NULL id counts for no component_id. An empty table gives no rows.
    """
    rows = materialize(identified(vectors))
    nodes = distinct_vectors(rows)
    found = materialize(links(nodes, threshold, recall, sample_size))
    counts = found.where(F.col("b") == -1).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = materialize(components(found.where(F.col("b") != -1), "a", "b"))
    smallest = roots.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("smallest"))
    joined = roots.join(smallest, "root").select("node", "smallest", F.lit(True).alias("joined"))
    judged = nodes.select("node", "label", "width", "k1", "k2", "times", "first").join(counts, "node", "left").join(joined, "node", "left").select(
        F.col("label").alias("l"), F.col("width").alias("w"), F.col("k1").alias("h1"), F.col("k2").alias("h2"),
        (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"),
        F.when(F.col("joined"), F.col("smallest")).otherwise(F.col("first")).alias("component"),
    )
    same = F.col("usable") & (F.col("label") == F.col("l")) & (F.col("width") == F.col("w")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", "label", "usable", "width", "k1", "k2").join(judged, same, "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
