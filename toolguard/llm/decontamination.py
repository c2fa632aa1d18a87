"""Benchmark passages in documents, found by winnowing; DataFrame functions only.

Both sides keep the smallest k-gram hash of each sliding window. Any shared span as long
as a window has its smallest hash kept on both sides, so joining the kept hashes
finds every document that can hold a passage. In those documents each hit is extended
to the windows around it, which are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolguard.functions.constants import let
from toolguard.scale import materialize

WINDOW = 13
GRAM = 8
#: Words once A-Z are lower case: digits, letters and everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words with A-Z in lower case; none for NULL."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def loose(text: Column) -> Column:
    """All letters in lower case, and one form of the letter whose form depends on what follows."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def loose_words(text: Column) -> Column:
    """As many words, but loose: quicker, and equal wherever the exact words are."""
    return F.regexp_extract_all(loose(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def keys(text: Column) -> list[Column]:
    """Two hashes that together stand for a whole text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(9), text).alias("k2")]


def gram_hashes(of: Column, k: int) -> Column:
    """A hash of the ``k`` words from each word on."""
    return F.transform(F.sequence(F.lit(1), F.size(of) - (k - 1)), lambda at: F.xxhash64(F.lit(k), F.slice(of, at, k)))


def sliding_least(of: Column, wide: int) -> Column:
    """The least of each ``wide`` successive values."""
    return F.transform(F.sequence(F.lit(1), F.size(of) - (wide - 1)), lambda at: F.array_min(F.slice(of, at, wide)))


def surroundings(of: Column, at: Column, k: int, ahead: int) -> Column:
    """For grams that start at ``at``: their start, and the words from ``ahead`` before to ``ahead`` after them."""

    def one(place: Column) -> Column:
        first = F.greatest(place - ahead, F.lit(1))
        return F.struct(place.alias("at"), first.alias("first"), F.slice(of, first, place - first + k + ahead).alias("near"))

    return F.transform(at, one)


def plans(lengths: list[int], gram: int = GRAM) -> list[tuple[int, int]]:
    """(k, shortest span): one plan for all windows of ``gram`` words or more, one for each shorter length."""
    long = [n for n in lengths if n >= gram]
    return [(n, n) for n in sorted(lengths) if n < gram] + ([(gram, min(long))] if long else [])


def winnow(df: DataFrame, of: str, made: list[tuple[int, int]]) -> DataFrame:
    """``df`` with ``kept``: the hashes kept of its words in column ``of``."""
    n = F.size(of)
    none = F.array().cast("array<bigint>")
    for i, (k, span) in enumerate(made):
        df = df.withColumn(f"__g{i}", F.when(n >= span, gram_hashes(F.col(of), k)).otherwise(none))
        if span > k:
            wide, grams = span - k + 1, F.col(f"__g{i}")
            df = df.withColumn(f"__g{i}", F.when(F.size(grams) >= wide, sliding_least(grams, wide)).otherwise(none))
    names = [f"__g{i}" for i in range(len(made))]
    return df.withColumn("kept", F.array_distinct(F.concat(*names) if names else none)).drop(*names)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, length, item_id): each different window of each item; a shorter item is one window."""

    def of_item(w: Column) -> Column:
        length = F.least(F.lit(window), F.size(w))
        starts = F.sequence(F.lit(1), F.size(w) - length + 1)
        made = F.transform(starts, lambda at: F.struct(F.array_join(F.slice(w, at, length), " ").alias("window"), length.alias("length")))
        return F.when(F.size(w) > 0, made)

    # Through a variable, so that an item is split once and not once for each window.
    return benchmark.select("item_id", F.explode(let(words(F.col("text")), of_item)).alias("x")).select("x.window", "x.length", "item_id").distinct()


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, k1, k2, n_words), and for each text with a passage (k1, k2, n_hit, items).

    ``items`` are the item ids as strings, sorted.
    """
    passages = materialize(windows(benchmark, window))
    lengths = sorted(r["length"] for r in passages.select("length").distinct().collect())  # at most ``window`` of them
    made = plans(lengths, gram)
    reach = max(lengths, default=gram)
    item_words = benchmark.select(loose_words(F.col("text")).alias("w"))
    # Items of 13 words or more keep what windows of the shortest span keep.
    marks = materialize(winnow(item_words, "w", made).select(F.explode("kept").alias("mark")).distinct())
    split = docs.select("doc_id", *keys(F.col("text")), loose_words(F.col("text")).alias("w"))
    rows = materialize(winnow(split, "w", made).select("doc_id", "k1", "k2", F.size("w").alias("n_words"), "kept"))

    touched = rows.select("doc_id", "k1", "k2", F.explode("kept").alias("mark")).join(marks, "mark")
    # One row of each text is enough.
    one = materialize(touched.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")))
    texts = docs.select("doc_id", "text", *keys(F.col("text")))
    chosen = texts.join(
        one.withColumnsRenamed({"k1": "c1", "k2": "c2"}),
        (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("id")),
    ).select("k1", "k2", words(F.col("text")).alias("w"))
    # Read twice for each plan, and without the other texts.
    chosen = materialize(chosen.select("k1", "k2", "w", F.size("w").alias("n")))
    hits = None
    for k, span in made:
        here = [n for n in lengths if n >= span and (n >= gram or n == k)]
        ahead = reach - k
        long_enough = chosen.where(F.col("n") >= k)
        loosened = long_enough.select("k1", "k2", F.transform("w", loose).alias("lw"))
        grams = loosened.select("k1", "k2", F.posexplode(gram_hashes(F.col("lw"), k)).alias("at", "mark"))
        # At most one place for each word of a text.
        places = grams.join(marks, "mark").groupBy("k1", "k2").agg(F.collect_set(F.col("at") + 1).alias("places"))
        found = (
            long_enough.join(places, ["k1", "k2"])
            .select("k1", "k2", "n", F.explode(surroundings(F.col("w"), F.col("places"), k, ahead)).alias("x"))
            .select("k1", "k2", "n", "x.*")
        )
        for length in here:
            # All windows of this length that hold the gram at ``at``.
            start = F.sequence(F.greatest(F.col("at") - (length - k), F.lit(1)), F.least(F.col("at"), F.col("n") - (length - 1)))
            part = (
                found.where(F.col("n") >= length)
                .select("k1", "k2", "first", "near", F.explode(start).alias("start"))
                .select("k1", "k2", "start", F.lit(length).alias("length"), F.array_join(F.slice("near", F.col("start") - F.col("first") + 1, length), " ").alias("window"))
            )
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = passages.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("start"), "length", "window")
    matched = hits.distinct().join(passages, ["window", "length"])
    spans = matched.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    # Lengths of the sorted spans' union: each adds what lies beyond the furthest end so far.
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans", zero,
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("total"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        ),
    )["total"]
    return rows, materialize(spans.select("k1", "k2", covered.cast("long").alias("n_hit"), "items"))


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    joined = rows.select("doc_id", "k1", "k2", F.col("n_words").cast("long").alias("n_words")).join(found, ["k1", "k2"], "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "k1", "k2", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs`` (doc_id, text; others are ignored).

    A word is hit if it lies in any occurrence of a window of ``benchmark`` (item_id, text): ``window``
    consecutive words of an item, or a shorter item whole. NULL and empty texts have no words and no
    windows. Rows with equal texts get equal results, repeated rows come back as often as they
    are there. Items that share an id are one; words of an item without id are hit but it is not
    listed. Empty tables give no rows, or rows without hits.
    """
    return judged(*find(docs, benchmark, window, gram)).drop("k1", "k2")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without the contaminated ones; all columns and repeats kept."""
    bad = judged(*find(docs, benchmark, window, gram)).where("contaminated").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    bad = materialize(bad)
    k1, k2 = keys(docs["text"])
    return docs.join(bad, (k1 == bad["__k1"]) & (k2 == bad["__k2"]), "left_anti")
