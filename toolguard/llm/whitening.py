"""Whitening of embeddings: spectrum slicing of their covariance.

Vectors are rounded to whole numbers, so that sums are exact; each distinct one counts once.
The covariance is summed by Spark, centred first. Its leading eigenvalues are told apart by
counts: the inertia of the covariance less a shift, from an LDL' factorisation, says how many
eigenvalues lie above the shift, and halving intervals isolates each. Rayleigh quotient
iteration converges inside an interval, and counts on both sides certify each number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolguard.llm.common import map_arrow
from toolguard.scale import materialize

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues up to this share of their sum count as zero: vectors don't differ in that direction.
ZERO = 1e-10
#: Entries of this size or more are cut to it, so that whole numbers stay in range.
LARGEST = 1 << 60
ROWS = 4096


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` lie above ``shift``: pivots of LDL', by Bunch and Kaufman."""
    m = a - shift * np.eye(len(a))
    alpha = (1 + np.sqrt(17)) / 8
    above = 0
    while len(m):
        column = np.abs(m[1:, 0])
        if not len(column) or column.max() == 0.0:
            above += m[0, 0] > 0
            m = m[1:, 1:]
            continue
        r = int(column.argmax()) + 1
        most = column[r - 1]
        two = False
        if abs(m[0, 0]) < alpha * most:
            other = np.abs(np.delete(m[r], r)).max()
            if abs(m[0, 0]) * other < alpha * most * most:
                if abs(m[r, r]) >= alpha * other:
                    m = _swap(m, 0, r)
                else:
                    m, two = _swap(m, 1, r), True
        if two:
            block = m[:2, :2]
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            above += 1 if det < 0 else 2 * int(block[0, 0] > 0)
            m = m[2:, 2:] - m[2:, :2] @ np.linalg.solve(block, m[:2, 2:])
        else:
            above += m[0, 0] > 0
            m = m[1:, 1:] - np.outer(m[1:, 0], m[1:, 0] / m[0, 0])
    return int(above)


def _swap(m: np.ndarray, i: int, j: int) -> np.ndarray:
    order = np.arange(len(m))
    order[[i, j]] = order[[j, i]]
    return m[np.ix_(order, order)]


def leading(a: np.ndarray, most: int = COMPONENTS, zero: float = ZERO) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a covariance, falling, and their unit vectors as rows.

    Fewer, if the others are zero. Of equal eigenvalues any orthogonal vectors come back. Each
    vector's largest entry is positive.
    """
    size, trace = len(a), float(np.trace(a))
    values, vectors = np.zeros(0), np.zeros((0, size))
    if size == 0 or not trace > 0:
        return values, vectors
    radius = float(np.abs(a).sum(axis=1).max())
    tiny = 8 * size * np.finfo(float).eps * radius
    counts = {zero * trace: inertia(a, zero * trace), radius + tiny: 0}
    random = np.random.default_rng(13)
    for k in range(1, min(most, counts[zero * trace]) + 1):
        while True:
            low = max(s for s, c in counts.items() if c >= k)
            high = min(s for s, c in counts.items() if c < k and s > low)
            alone = counts[low] == k and counts[high] == k - 1
            middle = (low + high) / 2
            if alone or high - low <= tiny:
                found = _iterate(a, middle, vectors, random.standard_normal(size), tiny)
                if found is not None and low - tiny <= found[0] <= high + tiny:
                    break
                if high - low <= np.spacing(high) * 4:
                    raise ArithmeticError("an eigenvector did not converge")
            counts[middle] = inertia(a, middle)
        values, vectors = np.append(values, found[0]), np.vstack([vectors, found[1]])
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[order]
    for k, value in enumerate(values, 1):
        # The k-th: fewer than k eigenvalues above it, k or more not below it.
        if inertia(a, value + 4 * tiny) >= k or inertia(a, value - 4 * tiny) < k:
            raise ArithmeticError("counts do not certify the eigenvalues")
    top = np.abs(vectors).argmax(axis=1)
    return values, vectors * np.sign(vectors[np.arange(len(vectors)), top])[:, None]


def _iterate(a: np.ndarray, shift: float, known: np.ndarray, x: np.ndarray, tiny: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration beside the known vectors, from two steps of inverse iteration."""
    value = shift
    for step in range(40):
        x -= known.T @ (known @ x)
        x -= known.T @ (known @ x)
        x /= np.linalg.norm(x)
        if step > 1:
            value = float(x @ a @ x)
            if np.linalg.norm(a @ x - value * x) <= tiny / 8:
                return value, x
        x = _solve(a, value, tiny, x)
    return None


def _solve(a: np.ndarray, shift: float, tiny: float, x: np.ndarray) -> np.ndarray:
    """(a - shift)^-1 x; where the shift is an eigenvalue itself, one beside it."""
    for near in (shift, shift + tiny, shift - tiny, shift + 3 * tiny, shift - 3 * tiny):
        with np.errstate(all="ignore"):
            try:
                found = np.linalg.solve(a - near * np.eye(len(a)), x)
            except np.linalg.LinAlgError:
                continue
        if np.isfinite(found).all():
            return found
    return x


def rounded(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): whole numbers of the usable vectors, shorter ones filled up with those of zeros."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = vectors.select("vec_id", x.alias("x")).where(F.col("x").isNotNull() & finite)
    width = usable.agg(F.max(F.size("x"))).first()[0] or 0
    limit = F.lit(float(LARGEST))
    whole = lambda v: F.floor(F.least(F.greatest(v * SCALE, -limit), limit)) + SHIFT
    filled = F.concat(F.transform("x", whole), F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))
    return materialize(usable.select("vec_id", filled.alias("x")))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.num_columns - 1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums by dimension: low and high bits apart, so that no long overflows."""
    for batch in _slices(batches):
        x = _matrix(batch)
        high, low = (x >> 24).sum(axis=0), (x & ((1 << 24) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1]), pa.int32()), pa.array(high), pa.array(low)], ["i", "high", "low"])


@dataclass
class Centre:
    """Number and sums of the distinct vectors: the mean is ``whole + part``, exact in ``n`` and ``sums``."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = [s % self.n for s in self.sums]
        self.part = np.array([r / self.n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sum)^2, exact; None if it is no long."""
        about = (np.square(self.n * self.centred(x))).sum(axis=1)
        small = about < 2.0**62
        found: list[int | None] = [None] * len(x)
        if small.any():
            rest = np.array(self.rest, dtype=np.int64)
            exact = np.square((x[small] - self.whole) * self.n - rest).sum(axis=1)
            for i, value in zip(np.flatnonzero(small).tolist(), exact.tolist(), strict=True):
                found[i] = value
        for i in np.flatnonzero(~small).tolist():
            value = sum((self.n * (v - w) - r) ** 2 for v, w, r in zip(x[i].tolist(), self.whole.tolist(), self.rest, strict=True))
            found[i] = value if value < 1 << 63 else None
        return found


def covariance(distinct: DataFrame, centre: Centre, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the centred vectors, or of their projections; tasks add up products, Spark adds up tasks."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _slices(batches):
            y = centre.centred(_matrix(batch))
            y = y if project is None else y @ project.T
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    parts = map_arrow(distinct, products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    size = len(centre.sums) if project is None else len(project)
    found = np.zeros((size, size))
    for r in parts.collect():  # one row for two dimensions
        found[r["i"], r["j"]] = found[r["j"], r["i"]] = r["s"] / centre.n
    return found


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors`` (vec_id, embedding; others are ignored).

    Vectors that are NULL or hold NULL or non-finite entries have no rows, repeated ones have
    theirs each. Shorter vectors count as filled up with zeros. Directions without variance are
    no components, so equal vectors, a single one or an empty table give no rows.
    ``deviation`` is NULL where it exceeds a long.
    """
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = rounded(vectors)
    distinct = materialize(rows.select("x").distinct())
    sums = map_arrow(distinct, _sums, "i int, high long, low long").groupBy("i").agg(
        F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low")
    )
    totals = {r["i"]: (int(r["high"]) << 24) + int(r["low"]) for r in sums.collect()}  # one row a dimension
    n = distinct.count()
    if not totals:
        return vectors.sparkSession.createDataFrame([], schema)
    centre = Centre(n, [totals[i] for i in range(len(totals))])
    spread = covariance(distinct, centre)
    values, components = leading(spread, most)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    project = components / np.sqrt(values)[:, None]
    error = float(np.abs(covariance(distinct, centre, project) - np.eye(len(values))).max())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _matrix(batch)
            white = centre.centred(x) @ project.T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(centre.deviations(x), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))],
                ["vec_id", "deviation", "white"],
            )

    shares = F.array(*(F.lit(float(v)) for v in values / np.trace(spread)))
    return (
        map_arrow(rows, found, "vec_id bigint, deviation bigint, white array<double>")
        .select("vec_id", "deviation", F.posexplode("white").alias("i", "whitened"))
        .select(
            "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            shares[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
