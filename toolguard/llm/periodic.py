"""Periodic runs of words by online dyadic square catching.

Words are appended in portions of any size. Whenever a block of 2^k words is complete, a
catcher holds it and compares it with the suffixes of 2^k words that end in the words appended
next. A block that comes back q words later, 2^k <= q < 2^(k+1), is half of a square of period q.
Squares grow to both sides and merge into runs. A run of period q and three periods or more
holds a whole block of its level in its first two periods, so its catcher reports it.
Suffixes are compared by names: a window of 2^(k+1) words is named after the names of its
halves. Runs are checked word by word in the end, so no result rests on a name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from toolguard.llm.common import by_bytes, map_arrow, texts_of

#: Words of a run and its periods at least; the method needs three periods.
LEAST, TIMES = 24, 3
#: Bytes of text whose words are appended to one catcher: names take some hundred bytes a word.
SIDE_BY_SIDE = 1 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return (x ^ (x >> np.uint64(32))) * _ODD[1]


class SquareCatcher:
    """Runs of at least ``least`` words and ``times`` periods (3 or more) among the words appended so far.

    Words are whole numbers; equal numbers are equal words.
    """

    def __init__(self, least: int = LEAST, times: int = TIMES):
        if times < 3:
            raise ValueError("squares are caught for runs of three periods or more")
        self.least, self.times = least, times
        self.words = np.zeros(0, dtype=np.int64)
        #: names[k][i] stands for the 2**k words from i on.
        self.names: list[np.ndarray] = []
        #: Ends of runs and of repetitions that may still grow, by start and period.
        self.found: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        before, self.words = len(self.words), np.concatenate([self.words, words])
        n = len(self.words)
        seen = [len(x) for x in self.names]
        self._name()
        self._grow(before)
        for k, names in enumerate(self.names):
            size = 1 << k
            # Suffixes that are new, each against the block before the one that it starts in.
            at = np.arange(max(size, seen[k] if k < len(seen) else 0), len(names))
            block = ((at >> k) - 1) << k
            same = np.flatnonzero(names[at] == names[block])
            if len(same):
                self._report(block[same], (at - block)[same], size)
        self.found = {k: end for k, end in self.found.items() if end == n or self._long(*k, end)}

    def _long(self, start: int, period: int, end: int) -> bool:
        return end - start >= max(self.least, self.times * period)

    def _name(self) -> None:
        n = len(self.words)
        k = 0
        while k == 0 or self.times << k <= n:
            if k == len(self.names):
                self.names.append(np.zeros(0, dtype=np.uint64))
            done, size = len(self.names[k]), n - (1 << k) + 1
            if size > done:
                if k == 0:
                    fresh = _mix(self.words[done:].astype(np.uint64) * _ODD[0] + _ODD[1])
                else:
                    lower, half = self.names[k - 1], 1 << (k - 1)
                    fresh = _mix(lower[done:size] * _ODD[1] + lower[done + half : size + half])
                self.names[k] = np.concatenate([self.names[k], fresh])
            k += 1

    def _grow(self, before: int) -> None:
        """Repetitions that ended with the last word go on into the new ones."""
        ended = [k for k, end in self.found.items() if end == before]
        if ended:
            starts, periods = np.array(ended).T
            for key, end in zip(ended, self._right(np.full(len(ended), before), periods).tolist(), strict=True):
                self.found[key] = end

    def _report(self, block: np.ndarray, period: np.ndarray, size: int) -> None:
        """Squares of new suffixes, but for those in repetitions of a shorter period, become repetitions."""
        if self.found:
            spans = np.array(sorted((s, e) for (s, p), e in self.found.items() if p < size), dtype=np.int64).reshape(-1, 2)
            reach = np.maximum.accumulate(spans[:, 1]) if len(spans) else np.zeros(0, dtype=np.int64)
            place = np.searchsorted(spans[:, 0], block, side="right") - 1
            inside = np.zeros(len(block), dtype=bool)
            inside[place >= 0] = reach[place[place >= 0]] >= (block + period + size)[place >= 0]
            block, period = block[~inside], period[~inside]
        end = self._right(block + period + size, period)
        start = self._left(block, period)
        last = end == len(self.words)
        keep = last | (end - start >= np.maximum(self.least, self.times * period))
        for s, p, e in zip(start[keep].tolist(), period[keep].tolist(), end[keep].tolist(), strict=True):
            self.found[s, p] = e

    def _right(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How far words go on to equal the words a period before them."""
        at = at.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names, todo = self.names[k], np.arange(len(at))
            while len(todo):
                todo = todo[at[todo] < len(names)]
                todo = todo[names[at[todo]] == names[at[todo] - period[todo]]]
                at[todo] += 1 << k
        return at

    def _left(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        at = at.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names, todo = self.names[k], np.arange(len(at))
            while len(todo):
                back = at[todo] - (1 << k)
                todo, back = todo[back >= 0], back[back >= 0]
                todo = todo[names[back] == names[back + period[todo]]]
                at[todo] -= 1 << k
        return at

    def _exact(self, start: int, period: int, end: int) -> tuple[int, int, int] | None:
        """The run by its words: names that agree by chance are found out here."""
        w = self.words
        if np.array_equal(w[start : end - period], w[start + period : end]):
            return start, end - start, period
        apart = np.flatnonzero(w[:-period] != w[period:])
        middle = (start + end - period) // 2
        place = int(np.searchsorted(apart, middle))
        first = int(apart[place - 1]) + 1 if place else 0
        stop = (int(apart[place]) if place < len(apart) else len(w) - period) + period
        return (first, stop - first, period) if self._long(first, period, stop) else None

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of each run, its period the smallest one, by start and period."""
        exact = {self._exact(s, p, e) for (s, p), e in self.found.items() if self._long(s, p, e)} - {None}
        found: list[tuple[int, int, int]] = []
        around: list[tuple[int, int]] = []  # (end, period) of earlier ones that go on here: few, as all have three periods
        for start, length, period in sorted(exact, key=lambda r: (r[0], -r[1], r[2])):
            around = [r for r in around if r[0] > start]
            # A repetition inside one of a shorter period has that period too.
            if not any(end >= start + length and p < period for end, p in around):
                found.append((start, length, period))
            around.append((start + length, period))
        return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Runs and words of each text; all texts pass one catcher, parted by words of their own."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    parts, starts, at = [], [], 0
    for i, w in enumerate(words):
        starts.append(at)
        parts += [np.fromiter(map(ids.__getitem__, w), dtype=np.int64, count=len(w)), np.array([-1 - i])]
        at += len(w) + 1
    catcher = SquareCatcher()
    if parts:
        catcher.append(np.concatenate(parts))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = catcher.runs()
    owners = np.searchsorted(starts, [r[0] for r in runs], side="right") - 1
    for owner, (start, length, period) in zip(owners.tolist(), runs, strict=True):
        found[owner].append((start - starts[owner], length, period))
    return zip(found, words, strict=True)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words less those that some run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of ``docs`` (doc_id, text; others are ignored).

    ``runs`` has (start, length, period) of each run by start, then period; ``collapsed`` the
    text with each run cut to its first period. NULL and empty texts have no words. Rows that
    repeat come back as often as they are there; an empty table gives no rows. One text is
    handled in one task, with some hundred bytes a word.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in by_bytes(batches, "text", SIDE_BY_SIDE):
            runs, texts = [], []
            for each, words in runs_of(list(texts_of(batch))):
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in each])
                texts.append(collapse(words, each).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return map_arrow(
        docs.select("doc_id", "text"), found, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )
