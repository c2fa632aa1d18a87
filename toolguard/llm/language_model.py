"""Log-likelihood of whole documents under a gated recurrent language model.

Words are counted over all training documents. The most frequent ones are a bounded
dictionary that is broadcast; the others meet their counts in a join. The model, a gated
recurrent unit in numpy, is trained by truncated backpropagation through time on each of them once: shards,
in number proportional to the words, train side by side, and their parameters are averaged
round by round, by groups of shards first.
Its softmax is factored by classes, and in each class by a binary tree, so that every word of
the dictionary has an output of its own, and is an input. Other words are told apart by their
last letters, and in those the counts of the whole corpus decide.
Documents are scored in windows of steps whose state carries over to the next.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolguard.llm.common import by_bytes, fold, map_arrow, shipped
from toolguard.scale import materialize

#: Words broadcast at most, and the longest of them in bytes: 19 MB at the very most.
DICTIONARY = 300_000
LONGEST = 64
#: Classes of symbols, and symbols of words outside the dictionary by their last letters.
CLASSES, ENDINGS = 64, 32
#: Rows of parameters for inputs and for nodes of the trees. Three quarters of them are of one symbol or node alone, the others are shared.
INPUTS, NODES = 4096, 4096
HIDDEN = 16
#: Symbols of a shard, and rounds of averaging; each round has its part of the documents.
SHARD = 1 << 20
ROUNDS = 4
#: Shards whose parameters are averaged in one task.
GROUP = 16
#: Streams side by side at most, steps back, and windows of a shard's round at least (with fewer streams).
STREAMS, BACK, WINDOWS = 512, 16, 16
RATE = 1.5e-2
#: Steps in a window of scoring, bytes of text scored side by side, states whose outputs and documents whose steps go together.
WINDOW = 48
SIDE_BY_SIDE = 32 << 20
OUTPUTS, ABREAST = 1 << 13, 1 << 12
#: Different words that a counting task holds before it passes them on.
HELD = 400_000


def tokenize(text: str) -> list[bytes]:
    """Words in UTF-8, A-Z in lower case, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def ending(word: bytes) -> str:
    return word.decode("utf-8", "replace")[-2:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in by_bytes(batches, "text"):
        for value in batch.column(0):
            held.update(tokenize(value.as_py() or ""))
            if len(held) >= HELD:
                yield made()
                held.clear()
    yield made()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c, ending) over all of ``training``; words as bytes. Batches count first, then tasks, then the cluster."""
    counted = map_arrow(training.select("text"), _count, "word binary, n long")
    return materialize(
        counted.groupBy("word").agg(F.sum("n").alias("c")).withColumn("ending", F.substring(F.col("word").cast("string"), -2, 2))
    )


def dictionary(counts: DataFrame, most: int) -> pa.Table:
    """(word, c) of the most frequent words, ``most`` or fewer: all that are as frequent as the last or more."""
    steps = F.floor(F.log2("c") * 16).alias("step")
    short = counts.where(F.octet_length("word") <= LONGEST)
    sizes = short.groupBy(steps).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in sizes:  # some hundred rows: counts on a logarithmic scale
        if total + row["n"] > most:
            break
        total, least = total + row["n"], row["least"]
    if least is None:
        return pa.table({"word": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
    return short.where(F.col("c") >= least).select("word", "c").toArrow()


class Lexicon:
    """Symbols: 0 is the end, 1 to ``words`` in number are words, then endings, the last for all others.

    Each symbol is of a class. From the root of its class's tree a path of turns leads to it: twice a node, and one more for the second side.
    """

    def __init__(self, text: bytes, endings: list[str], of: np.ndarray, row: np.ndarray, starts: np.ndarray, turns: np.ndarray, lean: np.ndarray, slot: np.ndarray):
        self.fields = (text, endings, of, row, starts, turns, lean, slot)
        self.text, self.endings, self.turns, self.lean, self.slot = text, endings, turns, lean, slot
        self.of, self.row, self.starts = (a.astype(np.int64) for a in (of, row, starts))
        self.size = len(of)
        self.rest = self.size - 1
        self.classes = int(of.max()) + 1
        self.inputs, self.nodes = int(row.max()) + 1, int(slot.max(initial=0)) + 1
        self.by_ending = {e: self.rest - len(endings) + i for i, e in enumerate(endings)}

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def symbol(self) -> dict[bytes, int]:
        return {w: i + 1 for i, w in enumerate(self.words)}

    def other(self, word: bytes) -> int:
        return self.by_ending.get(ending(word), self.rest)

    def code(self, word: bytes) -> int:
        found = self.symbol.get(word)
        return self.other(word) if found is None else found

    def paths(self, symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Symbols' places in an order of their paths' lengths, longest first; and for each level the turns of those that reach it."""
        first = self.starts[symbols]
        lengths = (self.starts[symbols + 1] - first).astype(np.uint16)
        order = np.argsort(~lengths, kind="stable")
        first = first[order]
        reach = len(symbols) - np.cumsum(np.bincount(lengths, minlength=1))[:-1]
        return order, [self.turns[first[:n] + level] for level, n in enumerate(reach)]


def shared_rows(n: int, rows: int, key: np.ndarray) -> np.ndarray:
    """Rows of ``n`` things: the first have rows of their own, the others share what is left by their ``key``."""
    own = n if n <= rows else rows * 3 // 4
    at = np.arange(n)
    return np.where(at < own, at, own + key % max(rows - own, 1)).astype(np.uint16)


def lexicon(head: list[tuple[bytes, int]], ends: int, endings: list[str], others: list[int] | None = None) -> Lexicon:
    """All words of ``head`` (word, count), the end, the endings and the rest in classes of about equal total frequency.

    ``others`` are the counts of the endings and of the rest. The trees of the classes go along last letters, and
    each node parts its frequency as evenly as it can, so frequent words have short paths.
    """
    words, tails = [w for w, _ in head], [e.encode("utf-8", "surrogatepass") for e in endings]
    mass = np.array([ends, *(c for _, c in head), *([0] * (len(endings) + 1) if others is None else others)], dtype=float) + 0.5
    size = len(mass)
    order = np.argsort(-mass, kind="stable")
    share = np.cumsum(mass[order]) - mass[order] / 2
    of = np.empty(size, dtype=np.int32)
    of[order] = np.unique((share / mass.sum() * CLASSES).astype(np.int64), return_inverse=True)[1]

    names = [w[::-1] for w in (b"", *words, *tails, b"")]
    along = sorted(range(size), key=lambda i: (of[i], names[i]))
    sums = [0.0, *np.cumsum(mass[along]).tolist()]
    edges = np.searchsorted(of[along], np.arange(int(of.max()) + 2)).tolist()
    # The turn that leads to each symbol and node, -1 to a root; and the masses on both sides of a node.
    last, before, left, right = np.empty(size, dtype=np.int32), [], [], []
    open_parts = [(low, high, -1) for low, high in zip(edges, edges[1:], strict=False)]
    while open_parts:
        low, high, turn = open_parts.pop()
        if high - low == 1:
            last[along[low]] = turn
            continue
        half = (sums[low] + sums[high]) / 2
        middle = bisect_left(sums, half, low + 1, high - 1)
        if middle > low + 1 and sums[middle] - half > half - sums[middle - 1]:
            middle -= 1
        node = len(before)
        before.append(turn)
        left.append(sums[middle] - sums[low])
        right.append(sums[high] - sums[middle])
        open_parts += [(low, middle, 2 * node), (middle, high, 2 * node + 1)]

    left, right, before = np.array(left), np.array(right), np.array(before, dtype=np.int32)
    at, who, found = last, np.arange(size, dtype=np.int32), []
    while len(at):
        at, who = at[at >= 0], who[at >= 0]
        found.append((who, at))
        at = before[at >> 1] if len(at) else at
    who, turns = (np.concatenate(c) for c in zip(*found, strict=True))
    by_symbol = np.argsort(who, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=size))])

    # Inputs share rows by last letters; nodes with the least mass by their place.
    last_letters = np.array([zlib.crc32(n[:2][::-1]) for n in names], dtype=np.int64)
    heavy = np.argsort(-(left + right), kind="stable")
    slot = np.empty(len(heavy), dtype=np.uint16)
    slot[heavy] = shared_rows(len(heavy), NODES, np.arange(len(heavy)) * 0x9E3779B1 >> 8)
    lean = np.log(left / right).astype(np.float32)
    return Lexicon(b" ".join(words), endings, of, shared_rows(size, INPUTS, last_letters), starts, turns[by_symbol], lean, slot)


class Network:
    """A gated recurrent unit over symbols, whose outputs are classes and turns in their trees."""

    def __init__(self, parameters: dict[str, np.ndarray], lex: Lexicon):
        self.p, self.lex = parameters, lex

    @staticmethod
    def start(lex: Lexicon, frequency: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
        random = np.random.default_rng(seed)
        share = np.bincount(lex.of, weights=frequency + 0.5, minlength=lex.classes)
        return {
            "x": (random.standard_normal((lex.inputs, 3 * HIDDEN)) * 0.1).astype(np.float32),
            "u": (random.standard_normal((HIDDEN, 3 * HIDDEN)) / math.sqrt(HIDDEN)).astype(np.float32),
            "c": (random.standard_normal((HIDDEN, lex.classes)) * 0.05).astype(np.float32), "cb": np.log(share / share.sum()).astype(np.float32),
            "w": (random.standard_normal((lex.nodes, HIDDEN)) * 0.05).astype(np.float32),
        }

    def step(self, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        x, g = self.p["x"].take(self.lex.row.take(symbols), axis=0), h @ self.p["u"]
        gates = x[:, : 2 * HIDDEN]
        gates += g[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        with np.errstate(over="ignore"):  # 1 / infinity is the right gate
            np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = r * g[:, 2 * HIDDEN :]
        n += x[:, 2 * HIDDEN :]
        n *= -2  # tanh by an exponential, which is quicker
        with np.errstate(over="ignore"):
            np.exp(n, out=n)
        n += 1
        np.reciprocal(n, out=n)
        n *= 2
        n -= 1
        return n + z * (h - n), (z, r, n, g[:, 2 * HIDDEN :], h)

    def at_nodes(self, states: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of the other turn than the one taken at nodes, given the states there; and the nodes' vectors and their rows."""
        nodes = turns >> 1
        slots = self.lex.slot.take(nodes)
        vectors = self.p["w"].take(slots, axis=0)
        logits = np.einsum("ij,ij->i", states, vectors)
        logits += self.lex.lean.take(nodes)
        np.negative(logits, out=logits, where=(turns & 1) == 0)
        return logits, vectors, slots

    def log_probabilities(self, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """ln P(class) and ln P of the turns to the symbol in its class, of each symbol given its state."""
        logits = h @ self.p["c"]
        logits += self.p["cb"]
        found = logits[np.arange(len(h)), self.lex.of[symbols]].astype(np.float64) - log_sum(logits)
        order, levels = self.lex.paths(symbols)
        states, lost = h.take(order, axis=0), np.zeros(len(h))
        for turns in levels:
            lost[: len(turns)] += log_one_more(self.at_nodes(states[: len(turns)], turns)[0])
        found[order] -= lost
        return found

    def train_window(
        self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, weight: np.ndarray | None = None
    ) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients over one window of steps (steps x streams), truncated at its start, and the state after it.

        ``weight`` is 1 for symbols to learn from, 0 for the filling behind a shard's last one.
        """
        p, lex = self.p, self.lex
        steps, streams = inputs.shape
        kept, states = [], np.empty((steps, streams, HIDDEN), dtype=h.dtype)
        for t in range(steps):
            h = np.where(fresh[t][:, None], h.dtype.type(0), h)  # a document starts with an empty state
            h, cache = self.step(inputs[t], h)
            kept.append(cache)
            states[t] = h
        flat, goal = states.reshape(-1, HIDDEN), targets.reshape(-1)
        n = len(goal)
        share = np.full(n, 1 / n) if weight is None else weight.reshape(-1) / max(weight.sum(), 1.0)
        share = share.astype(h.dtype)
        of = lex.of[goal]
        d = softmax(flat @ p["c"] + p["cb"])
        d[np.arange(n), of] -= 1
        d *= share[:, None]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["c"], grads["cb"] = flat.T @ d, d.sum(axis=0)
        dh = d @ p["c"].T
        order, levels = lex.paths(goal)
        ordered, shares, at = flat.take(order, axis=0), share.take(order), 0
        d = np.zeros_like(ordered)
        rows, places = np.empty((sum(map(len, levels)), HIDDEN), dtype=h.dtype), []
        for turns in levels:
            reach, part = slice(len(turns)), slice(at, at + len(turns))
            e, vectors, slots = self.at_nodes(ordered[reach], turns)
            with np.errstate(over="ignore"):  # 1 / infinity is the right probability
                np.exp(-e, out=e)
            e += 1
            np.divide(shares[reach], e, out=e)  # the probability of the other turn
            np.negative(e, out=e, where=(turns & 1) == 0)
            vectors *= e[:, None]
            d[reach] += vectors
            np.multiply(ordered[reach], e[:, None], out=rows[part])
            places.append(slots)
            at += len(turns)
        dh[order] += d
        if levels:
            add_rows(grads["w"], np.concatenate(places), rows)
        dh = dh.reshape(steps, streams, HIDDEN)
        back = np.zeros((streams, HIDDEN), dtype=h.dtype)
        dx, dg, before = (np.empty((steps, streams, k * HIDDEN), dtype=h.dtype) for k in (3, 3, 1))
        for t in range(steps - 1, -1, -1):
            z, r, m, gn, before[t] = kept[t]
            back += dh[t]
            dm = back * (1 - z) * (1 - m * m)
            dx[t, :, :HIDDEN] = back * (before[t] - m) * z * (1 - z)
            dx[t, :, HIDDEN : 2 * HIDDEN] = dm * gn * r * (1 - r)
            dx[t, :, 2 * HIDDEN :] = dm
            dg[t, :, : 2 * HIDDEN] = dx[t, :, : 2 * HIDDEN]
            dg[t, :, 2 * HIDDEN :] = dm * r
            back = np.where(fresh[t][:, None], h.dtype.type(0), back * z + dg[t] @ p["u"].T)
        grads["u"] = before.reshape(n, -1).T @ dg.reshape(n, -1)
        add_rows(grads["x"], lex.row[inputs.reshape(-1)].astype(np.uint16), dx.reshape(n, -1))
        return grads, h


def add_rows(sums: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
    """Sets the rows of ``sums`` at ``places`` to the sums of ``rows`` of the same place, added up in their order."""
    order = np.argsort(places, kind="stable")
    places = places[order]
    starts = np.flatnonzero(np.diff(places.astype(np.int64), prepend=-1))
    sums[places[starts]] = np.add.reduceat(rows.take(order, axis=0), starts, axis=0)


def log_one_more(x: np.ndarray) -> np.ndarray:
    """ln(1 + e^x)."""
    with np.errstate(over="ignore"):
        found = np.log(1 + np.exp(x))
    return found if np.isfinite(found).all() else np.logaddexp(0, x)


def log_sum(x: np.ndarray) -> np.ndarray:
    """ln of the sum of exponentials of each row."""
    with np.errstate(over="ignore"):
        total = np.exp(x) @ np.ones(x.shape[1], dtype=x.dtype)
    if np.isfinite(total).all() and total.min(initial=1.0) > 1e-30:
        return np.log(total.astype(np.float64))
    top = x.max(axis=1)  # only numbers that are out of range need more care
    return np.log(np.exp(x - top[:, None]).sum(axis=1, dtype=np.float64)) + top


def softmax(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        e = np.exp(x)
        total = e @ np.ones(x.shape[1], dtype=x.dtype)
    if not np.isfinite(total).all() or total.min(initial=1.0) < 1e-30:  # out of range
        e = np.exp(x - x.max(axis=1, keepdims=True))
        total = e.sum(axis=1)
    e *= (1 / total)[:, None]
    return e


def train_shard(network: Network, documents: list[np.ndarray], rate: float) -> int:
    """One pass over a shard's documents, each a row of symbols that ends with 0. Returns the number of symbols.

    The symbols are dealt over streams; what is filled up behind the last one weighs nothing.
    """
    stream = np.concatenate(documents)
    n = len(stream)
    streams = max(1, min(STREAMS, n // (BACK * WINDOWS)))
    length = -(-n // streams)
    cut = lambda a: np.pad(a, (0, streams * length - n)).reshape(streams, length).T
    inputs, targets, weight = cut(np.concatenate([[0], stream[:-1]])), cut(stream), cut(np.ones(n, dtype=np.float32))
    fresh = inputs == 0
    h = np.zeros((streams, HIDDEN), dtype=np.float32)
    values = np.concatenate([v.ravel() for v in network.p.values()])
    ends = np.cumsum([v.size for v in network.p.values()])
    network.p = {k: values[end - v.size : end].reshape(v.shape) for (k, v), end in zip(network.p.items(), ends.tolist(), strict=True)}
    first, second, change = (np.zeros_like(values) for _ in range(3))
    done = 0
    for at in range(0, length, BACK):
        part = slice(at, at + BACK)
        grads, h = network.train_window(inputs[part], targets[part], fresh[part], h, weight[part])
        g = np.concatenate([grads[k].ravel() for k in network.p])
        g *= min(1.0, 1.0 / (math.sqrt(float(g @ g)) + 1e-12))
        done += 1
        # Adam, with clipped gradients, in place.
        first *= 0.9
        first += np.multiply(g, 0.1, out=change)
        second *= 0.99
        g *= g
        second += np.multiply(g, 0.01, out=change)
        np.sqrt(np.divide(second, 1 - 0.99**done, out=change), out=change)
        change += 1e-8
        np.divide(first, change, out=change)
        change *= rate / (1 - 0.9**done)
        values -= change
    return n


def encoded(training: DataFrame, fields: Broadcast, shards: int, rounds: int) -> DataFrame:
    """(shard, turn, doc_id, key, symbols) of each different (doc_id, text), symbols as bytes of four.

    By the text too: rows without an id, and different texts of one id, are spread as well.
    Only rows that repeat are shuffled to leave one of them.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(Lexicon(*fields.value))
        for whole in batches:
            for batch in by_bytes(iter([whole]), "text"):
                rows = [np.fromiter(map(own.__getitem__, [*tokenize(v.as_py() or ""), None]), dtype="<u4").tobytes() for v in batch.column(4)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rows, pa.binary())], ["shard", "turn", "doc_id", "key", "symbols"])

    place = lambda seed, parts, name: F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(parts)).cast("int").alias(name)
    rows = training.select(place(3, shards, "shard"), place(5, rounds, "turn"), "doc_id", F.xxhash64("text").alias("key"), "text")
    coded = materialize(map_arrow(rows, encode, "shard int, turn int, doc_id long, key long, symbols binary"))
    several = coded.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = materialize(several.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")))
    same = coded["doc_id"].eqNullSafe(several["__id"]) & (coded["key"] == several["__key"])
    again = coded.join(several, same, "left_semi").groupBy("shard", "turn", "doc_id", "key").agg(F.any_value("symbols").alias("symbols"))
    return coded.join(several, same, "left_anti").unionByName(again)


class Coder(dict):
    """Symbols of words, of the end for None; remembers a bounded number of words."""

    def __init__(self, lex: Lexicon):
        super().__init__()
        self.lex = lex

    def __missing__(self, word: bytes | None) -> int:
        if len(self) >= HELD:
            self.clear()
        found = self[word] = 0 if word is None else self.lex.code(word)
        return found


def train(training: DataFrame, lex: Lexicon, frequency: np.ndarray, tokens: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters learned from the texts of ``training`` (doc_id, text), which have ``tokens`` symbols.

    Each document is learned from once: every round each shard makes a pass over its documents
    of that round, then parameters are averaged. Rows that repeat an id and its text are learned from once.
    """
    context = training.sparkSession.sparkContext
    fields = context.broadcast(lex.fields)
    shards = max(1, -(-tokens // SHARD))
    coded = encoded(training, fields, shards, rounds)
    parameters = Network.start(lex, frequency)
    shapes = {k: parameters[k].shape for k in sorted(parameters)}
    schema = "shard int, n long, parameters array<binary>"
    for turn in range(rounds):
        part = coded.where(F.col("turn") == turn)
        learn = learner(context.broadcast(parameters), fields, RATE * (1 - turn / rounds))
        # An own number of partitions, else adaptive execution trains all shards in one small task.
        with shipped():
            found = part.repartition(2 * shards, "shard").groupBy("shard").applyInArrow(learn, schema)
            left = shards
            while left > GROUP:
                found = found.withColumn("shard", F.floor(F.col("shard") / GROUP).cast("int")).groupBy("shard").applyInArrow(averaged, schema)
                left = -(-left // GROUP)
            rows = sorted(found.collect(), key=lambda r: r["shard"])  # of GROUP shards at most
        if rows:
            blobs = average([(r["n"], r["parameters"]) for r in rows])
            parameters = {k: x.reshape(shapes[k]) for k, x in zip(shapes, blobs, strict=True)}
    return parameters


def average(rows: list[tuple[int, list[bytes]]]) -> list[np.ndarray]:
    """The mean of parameters, each weighed by the number of symbols that it was learned from."""
    total = sum(n for n, _ in rows)
    return [sum(np.frombuffer(p[i], "<f4") * np.float32(n / total) for n, p in rows) for i in range(len(rows[0][1]))]


def parameter_row(shard: int, n: int, values: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "shard": pa.array([shard], pa.int32()), "n": pa.array([n], pa.int64()),
        "parameters": pa.array([[x.astype("<f4").tobytes() for x in values]], pa.list_(pa.binary())),
    })


def averaged(table: pa.Table) -> pa.Table:
    """One row of parameters for a group of shards, in an order of their own so that sums come out alike."""
    rows = sorted(zip(table["n"].to_pylist(), table["parameters"].to_pylist(), strict=True))
    return parameter_row(table["shard"][0].as_py(), sum(n for n, _ in rows), average(rows))


def learner(shared: Broadcast, fields: Broadcast, rate: float):
    """A function that trains on one shard's rows from the shared parameters, and returns its own."""

    def learn(table: pa.Table) -> pa.Table:
        ordered = table.sort_by([("key", "ascending"), ("doc_id", "ascending")])
        network = Network({k: v.copy() for k, v in shared.value.items()}, Lexicon(*fields.value))
        documents = [np.frombuffer(x.as_py(), dtype="<u4").astype(np.int64) for x in ordered["symbols"]]
        n = train_shard(network, documents, rate)
        return parameter_row(table["shard"][0].as_py(), n, [network.p[k] for k in sorted(network.p)])

    return learn


def log_likelihoods(network: Network, documents: list[np.ndarray]) -> np.ndarray:
    """ln P of the symbols of each document, side by side: longest first, so that those still running are the first."""
    lengths = np.array([len(d) for d in documents])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([documents[i] for i in order])
    totals = np.zeros(len(documents))
    h = np.zeros((len(documents), HIDDEN), dtype=np.float32)
    last = np.zeros(len(documents), dtype=np.int64)
    for at in range(0, int(lengths[0]), WINDOW):
        running = int(np.searchsorted(-lengths, -at, side="left"))
        steps = min(WINDOW, int(lengths[0]) - at)
        for start in range(0, running, ABREAST):  # as many documents as fit a processor's cache
            part = slice(start, min(start + ABREAST, running))
            totals[part] += _window(network, flat, starts[part] + at, lengths[part] - at, h[part], last[part], steps)
    result = np.empty_like(totals)
    result[order] = totals
    return result


def _window(network: Network, flat: np.ndarray, starts: np.ndarray, left: np.ndarray, h: np.ndarray, last: np.ndarray, steps: int) -> np.ndarray:
    """ln P of the next ``steps`` symbols of documents, longest first; their states ``h`` and ``last`` symbols move on."""
    totals = np.zeros(len(starts))
    states, goals, owners, held = [], [], [], 0
    for t in range(steps):
        active = int(np.searchsorted(-left, -t, side="left"))
        if not active:
            break
        h[:active] = network.step(last[:active], h[:active])[0]
        goal = flat[starts[:active] + t]
        last[:active] = goal
        states.append(h[:active].copy())
        goals.append(goal)
        owners.append(np.arange(active))
        held += active
        if held > OUTPUTS or t + 1 == steps:
            totals += _spend(network, states, goals, owners, len(totals))
            states, goals, owners, held = [], [], [], 0
    return totals + _spend(network, states, goals, owners, len(totals)) if states else totals


def _spend(network: Network, states: list, goals: list, owners: list, size: int) -> np.ndarray:
    found = network.log_probabilities(np.concatenate(states), np.concatenate(goals))
    return np.bincount(np.concatenate(owners), weights=found, minlength=size)


class Places(dict):
    """Symbols of words in the dictionary, 0 for others."""

    def __missing__(self, word: bytes) -> int:
        return 0


def score(docs: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text; others are ignored).

    Learns from the rows whose crc32(doc_id) modulo 5 is not 1; a NULL id is a training row.
    NULL and empty texts are their end alone. Repeated rows count and come back as often as
    they are there. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(fold("doc_id") == 1, F.lit(False))
    training = docs.where(~held_out).select("doc_id", "text")
    counts = word_counts(training)
    ends = training.count()
    sums = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    below = math.log10(tokens + 0.5 * (distinct + 1))

    table = dictionary(counts, most)
    head = sorted(zip(table["word"].to_pylist(), table["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    endings = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    frequent = endings.orderBy(F.desc("c"), "ending").limit(ENDINGS - 1).collect()
    # Tokens and words by class of the words outside the dictionary: all of an ending less the dictionary's.
    weight = {r["ending"]: [r["c"], r["v"]] for r in frequent}
    weight[None] = [tokens - ends - sum(r["c"] for r in frequent), distinct - (ends > 0) - sum(r["v"] for r in frequent)]
    for word, c in head:
        row = weight[ending(word) if ending(word) in weight else None]
        row[0], row[1] = row[0] - c, row[1] - 1
    rows = [(max(c, 0), max(v, 0)) for c, v in weight.values()]
    lex = lexicon(head, ends, [r["ending"] for r in frequent], [r[0] for r in rows])
    frequency = np.array([ends, *(c for _, c in head), *(r[0] for r in rows)], dtype=float)
    inside = np.array([0.0] * (1 + len(head)) + [math.log10(c + 0.5 * (v + 1)) for c, v in rows])
    parameters = train(training, lex, frequency, tokens)

    shared = spark.sparkContext.broadcast((lex.fields, parameters, np.array([c for _, c in head], dtype=np.int64), inside, ends))
    names = ["doc_id", "n_tokens", "n_known", "base", "model", "words", "times"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, parameters, c, inside, ends = shared.value
        own = Lexicon(*fields)
        network = Network(parameters, own)
        place = Places(own.symbol)
        logs = np.concatenate([[0.0], np.log10(c + 0.5)])  # the first stands for words outside the dictionary
        end_log = math.log10(ends + 0.5)
        for batch in by_bytes(batches, "text", SIDE_BY_SIDE):
            documents, rows = [], []
            for value in batch.column(1):
                text = tokenize(value.as_py() or "")
                ids = np.fromiter(map(place.__getitem__, text), dtype=np.int64, count=len(text))
                symbols = np.zeros(len(text) + 1, dtype=np.int32)
                symbols[:-1] = ids
                missing = np.flatnonzero(ids == 0)
                tail = Counter(text[i] for i in missing)
                for i in missing:
                    symbols[i] = own.other(text[i])
                base = logs[ids]
                # What the endings leave to the corpus: their words' counts.
                model = -inside[symbols].sum()
                known = len(text) - len(missing) + (ends > 0)
                rows.append((len(text) + 1, known, base.sum() + end_log, model, list(tail), list(tail.values())))
                documents.append(symbols)
            found = log_likelihoods(network, documents) / math.log(10)
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()),
                pa.array(np.array(columns[3]) + found), pa.array(columns[4], pa.list_(pa.binary())), pa.array(columns[5], pa.list_(pa.int64())),
            ], names)

    judged = map_arrow(
        docs.select("doc_id", "text"), judge,
        "doc_id long, n_tokens long, n_known long, base double, model double, words array<binary>, times array<long>",
    )
    # Written at once, which settles the row numbers.
    judged = materialize(judged.withColumn("row", F.monotonically_increasing_id()))
    tail = judged.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = tail.join(counts.select("word", "c"), "word", "left")
    rest = met.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("times")).alias("rest"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("met")
    )
    rest_sum = F.coalesce("rest", F.lit(0.0))
    return judged.select("row", "doc_id", "n_tokens", "n_known", "base", "model").join(rest, "row", "left").select(
        "doc_id", held_out.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + rest_sum - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("model") + rest_sum).alias("score"),
    )
