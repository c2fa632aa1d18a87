"""Near copies by SimHash fingerprints, found by covering locality-sensitive hashing.

Seven bit masks over the 64 bits form a covering code: each bit has a non-zero
vector of three bits, each mask a non-zero vector of its own, and a mask holds the
bits whose vectors are not orthogonal to it. Two differing bits span at most a plane,
so some mask is orthogonal to both: every pair within radius 2 agrees on one mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolguard.llm.common import by_bytes, map_arrow, sieve, texts_of
from toolguard.llm.components import components
from toolguard.scale import discard, materialize

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Buckets up to this many fingerprints are compared pair by pair, larger ones by centres.
PAIRS = 32
_STEP = 1 << 15


def covering_masks(bits: int = 64, radius: int = RADIUS) -> list[int]:
    """2**(radius+1)-1 masks, as unsigned numbers, of which any ``radius`` differing bits miss one."""
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2) for v in range(1, size)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str) -> int:
    """Unsigned fingerprint of a whole text; 0 without words."""
    # bytes.lower changes A-Z only, bytes.split cuts at ASCII white space only.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, len(shingles), _STEP):  # long texts in steps of bounded memory
        part = shingles[start : start + _STEP]
        hashes = np.fromiter((digest(s, SEED) for s in part), dtype="<u8", count=len(part))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        found = [signed(fingerprint(x)) for x in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp) of every row, texts whole: a hash of the text, and the fingerprint as a signed long."""
    return map_arrow(docs.select("doc_id", text_key().alias("key"), "text"), _fingerprints, "doc_id bigint, key bigint, fp bigint")


def text_key(text: str | Column = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def links(distinct: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, b): links between fingerprints of column ``fp`` that connect all pairs within radius 2.

    Every link is within the radius. In buckets of up to ``pairs`` fingerprints all
    such pairs are listed. In larger ones each fingerprint goes to the centres at one
    bit's distance at most: two fingerprints are within radius 2 if and only if they
    share a centre, and a centre has 65 members at most. The same links then come
    as stars at each centre, so a bucket of any size costs rows in proportion to it.
    """
    masks = F.array(*(F.struct(F.lit(i).alias("mask"), F.lit(signed(m)).alias("bits")) for i, m in enumerate(covering_masks())))
    keys = distinct.select("fp", F.explode(masks).alias("m")).select(
        "fp", F.col("m.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("m.bits")).alias("key")
    )
    sizes = keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = materialize(keys.join(sizes, ["mask", "key"]))
    small = shared.where(F.col("n") <= pairs).select("mask", "key", "fp")
    other = small.withColumnRenamed("fp", "fp2")
    near = (
        small.join(other, ["mask", "key"])
        .where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS))
        .select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    )
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(64)))
    centres = (
        shared.where(F.col("n") > pairs).select("fp").distinct()
        .select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    )
    # 65 members at most: the centre and its neighbours.
    stars = (
        centres.groupBy("centre").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where(F.col("a") != F.col("b"))
    )
    return near.union(stars).distinct()


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key, fp), and for each fingerprint (fp, root, component_id)."""
    marked = materialize(fingerprints(docs))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = materialize(components(links(distinct), "a", "b")).select(F.col("node").alias("fp"), "root")
    smallest = roots.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("smallest"))
    joined = roots.join(smallest, "root")
    return marked, distinct.join(joined, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("smallest")).alias("component_id")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    NULL and empty texts have fingerprint zero and link like any other. A repeated
    row comes back as often as it is there. A NULL id counts for no component_id;
    a component of NULL ids only has NULL. An empty table gives no rows.
    """
    marked, found = groups(docs)
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` less all but one row of each group of near copies, all columns kept.

    The row with the group's smallest id stays (a NULL id counts as the largest, ties
    go by a hash of the text); a row that is repeated stays once, as its smallest
    form. An empty table gives no rows.
    """
    return keep_first(docs, *groups(docs))


def keep_first(docs: DataFrame, marked: DataFrame, found: DataFrame) -> DataFrame:
    """The first row of each group of ``docs``, given its rows (doc_id, key, fp) and the group (fp, root) of each fingerprint."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    rows = materialize(marked.join(found, "fp").groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("times")))
    first = rows.groupBy("root").agg(F.min(place).alias("first")).select("root", "first.doc_id", "first.key", F.lit(True).alias("stays"))
    judged = materialize(
        rows.join(first, (rows["root"] == first["root"]) & rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows["key"] == first["key"]), "left")
        .where(F.col("stays").isNull() | (F.col("times") > 1))
        .select(rows["doc_id"].alias("__id"), rows["key"].alias("__key"), (F.coalesce("stays", F.lit(False))).alias("__stays"))
    )
    discard(rows)
    once = without(docs, judged)
    # Repeated rows that stay: few, and combined before they are shuffled.
    again = at_places(docs, judged.where("__stays")).groupBy("__id", "__key").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return once.unionByName(again.select("__row.*"))


def _met(docs: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Rows of ``docs`` that may be at ``places`` (__id, __key), those that are not, and what joins the first with the places."""
    passes = sieve(places.select(F.xxhash64("__id", "__key")))
    place = F.xxhash64("doc_id", text_key())
    may = docs.where(passes(place))
    return may, docs.where(~passes(place)), may["doc_id"].eqNullSafe(places["__id"]) & (text_key(may["text"]) == places["__key"])


def at_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``docs`` joined with those of ``places`` (__id, __key and others) that they are at. Few other texts are shuffled."""
    may, _, same = _met(docs, places)
    return may.join(places, same)


def without(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``docs`` without the rows at ``places`` (__id, __key). Few texts of the rows that stay are shuffled."""
    may, never, same = _met(docs, places)
    return never.unionByName(may.join(places, same, "left_anti"))
