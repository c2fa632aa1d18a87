"""What several operators share: tables, words, folds, bounded samples, Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolguard import llm
from toolguard.scale import materialize

#: Words of the contracts that split at ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to one step inside a task, in bytes.
BATCH_BYTES = 4 << 20
#: Bytes of an Arrow batch where memory is short: below BATCH_BYTES, since its last row may pass the limit.
ARROW_BYTES = 3 << 20
#: Bits of a sieve at most (16 MB), and tasks that make one.
SIEVE_LOG = 27
SIEVE_TASKS = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: str | Column, parts: int = 5) -> Column:
    """crc32 of an id's text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % parts


def word_count(text: str | Column) -> Column:
    """Number of words split at ASCII white space; 0 for NULL."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


@contextmanager
def shipped():
    """Functions of this subpackage made inside travel to executors by value.

    Executors then need no copy of the library on their path.
    """
    cloudpickle.register_pickle_by_value(llm)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(llm)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function travels by value."""
    with shipped():
        return df.mapInArrow(function, schema)


def limit_batches(spark: SparkSession) -> None:
    """Python gets Arrow batches of about ``ARROW_BYTES`` from now on; else up to 10,000 whole texts lie in one, in the JVM and in the worker.

    It stays set, since what is built after it runs later; a lower limit of the session's own stays, too.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold about ``limit`` bytes of a text column, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Texts one at a time, '' for NULL."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py() or ""


def filter_rows(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows whose text a judge keeps, with all their columns, in one pass over ``docs``."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in by_bytes(batches, "text"):
            yield batch.filter(pa.array(judge(list(texts_of(batch))), pa.bool_()))

    limit_batches(docs.sparkSession)
    return map_arrow(docs, kept, docs.schema)


def sieve(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test of hashes that each value in the only column of ``hashes`` passes, and few others do.

    It is a bitmap of bounded size in every task, so that rows which fail it need no shuffle; rows which
    pass have to be joined. With more hashes than it is made for more rows pass, and none is lost. The test runs
    in the JVM: one in Python would need a second worker in each task that hands its rows on to Python.
    """
    log = min(SIEVE_LOG, max(10, (16 * hashes.count()).bit_length()))

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (log - 3), dtype=np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - log)
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["bits"])

    total = np.zeros(1 << (log - 3), dtype=np.uint8)
    for row in map_arrow(hashes.repartition(SIEVE_TASKS), bits_of, "bits binary").collect():
        total |= np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    longs = pa.ListArray.from_arrays([0, len(total) // 8], pa.array(total.view("<i8")))
    held = materialize(hashes.sparkSession.createDataFrame(pa.table({"longs": longs})))

    def test(column: Column) -> Column:
        at = F.shiftrightunsigned(column, 64 - log)
        return F.getbit(F.get(held.scalar(), F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of ``key``; all rows if there are no more than that."""
    count = rows.count()
    if count <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(most / count * (1 << 30)))


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, seed: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of the labelled rows outside the held-out fold.

    Only rows whose crc32(doc_id) modulo 5 is not 0 and whose label is not NULL count;
    an id that is labelled in both ways has the smaller label. Rows that repeat an id and its text
    count once; where ids of many texts bring more than a tenth beyond ``most``, texts are drawn once more by their hashes.
    The ids are bounded by ``most``, so they are broadcast; of texts only the sample is shuffled.
    """
    known = labels.where((fold("doc_id") != 0) & F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = bounded_sample(known.select("doc_id", F.col(column).cast("int").alias("label")), "doc_id", most, seed)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    different = rows.select("doc_id", "__key").distinct().count()
    if different > 1.1 * most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "__key"), F.lit(1 << 30)) < int(most / different * (1 << 30)))
    one = rows.groupBy("doc_id", "__key").agg(F.min("label").alias("label"), F.any_value(F.coalesce("text", F.lit(""))).alias("text"))
    return one.select("doc_id", "text", "label")
