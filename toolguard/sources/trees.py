"""Trees of files, listed folder by folder on executors, without the folders that are left out.

``pruned_trees`` is a data source of its own: its partitions are shares of the folders below a
root, each task lists its share, and a folder whose name is left out is never opened. It
yields paths and sizes; contents are loaded on demand, for the files that are chosen by then.
Paths are local ones or URIs of the stores that Arrow knows.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as store
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from toolguard import rules, sources
from toolguard.scale import materialize

#: Folders that hold no source in either language: dependencies, builds, version control.
LEFT_OUT = tuple(n for n in rules.PYTHON_PRUNED_DIRS if n in rules.JS_PRUNED_DIRS)
SCHEMA = "path string, size bigint, is_open boolean"
#: Folders that a task lists before it leaves the others to the next round, and rows of a batch.
FOLDERS = 4096
ROWS = 8192
#: Bytes of contents in a batch, and bytes of files that one task reads.
BATCH_BYTES = 8 << 20
TASK_BYTES = 64 << 20


@contextmanager
def shipped():
    """Helpers of this package travel to executors by value."""
    cloudpickle.register_pickle_by_value(sources)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(sources)


def located(path: str) -> tuple[store.FileSystem, str]:
    return store.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (store.LocalFileSystem(), path)


def children(files: store.FileSystem, root: str, folder: str, left_out: frozenset[str]) -> tuple[list[str], list[tuple[str, int]]]:
    """Folders to open and files right below ``folder``, by paths relative to ``root``; linked folders are not opened."""
    folders, found = [], []
    local = isinstance(files, store.LocalFileSystem)
    for info in files.get_file_info(store.FileSelector(posixpath.join(root, folder) if folder else root)):
        path = posixpath.join(folder, info.base_name)
        if info.type == store.FileType.Directory:
            if info.base_name.lower() not in left_out and not (local and os.path.islink(info.path)):
                folders.append(path)
        elif info.type == store.FileType.File:
            found.append((path, info.size))
    return folders, found


def batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, sizes, opens = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(opens, pa.bool_())], ["path", "size", "is_open"])


def walk(root: str, folders: list[str], left_out: frozenset[str], most: int | None) -> Iterator[pa.RecordBatch]:
    """Files below ``folders``; beyond ``most`` listed folders, those still to be opened."""
    files, base = located(root)
    todo, rows, listed = list(folders), [], 0
    while todo and (most is None or listed < most):
        listed += 1
        below, found = children(files, base, todo.pop(), left_out)
        todo += below
        rows += [(path, size, False) for path, size in found]
        if len(rows) >= ROWS:
            yield batch(rows)
            rows = []
    rows += [(path, None, True) for path in todo]
    if rows:
        yield batch(rows)


class Share(InputPartition):
    """One of ``of`` shares of the folders right below the root."""

    def __init__(self, number: int, of: int):
        super().__init__(number)
        self.number, self.of = number, of


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.left_out = frozenset(x for x in options.get("leftout", ",".join(LEFT_OUT)).lower().split(",") if x)
        self.shares = int(options.get("shares", 32))
        self.most = int(options["folders"]) if options.get("folders") else None

    def partitions(self) -> list[Share]:
        # The driver lists nothing: each task takes the folders of its share.
        return [Share(i, self.shares) for i in range(self.shares)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        files, base = located(self.root)
        folders, found = children(files, base, "", self.left_out)
        mine = lambda path: zlib.crc32(path.encode("utf-8", "surrogatepass")) % partition.of == partition.number
        here = [(path, size, False) for path, size in found if mine(path)]
        for start in range(0, len(here), ROWS):
            yield batch(here[start : start + ROWS])
        yield from walk(self.root, [f for f in folders if mine(f)], self.left_out, self.most)


class PrunedTrees(DataSource):
    """``spark.read.format("pruned_trees").load(root)``: (path, size, is_open) of the files below a folder.

    Options: ``leftout``, names of folders that are not opened, in any case, by commas; ``shares``,
    the number of tasks; ``folders``, how many folders a task lists at most: the others come as
    rows whose ``is_open`` is true. Without it every file is listed and no row is open.
    """

    @classmethod
    def name(cls) -> str:
        return "pruned_trees"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    with shipped():
        spark.dataSource.register(PrunedTrees)


def list_tree(spark: SparkSession, root: str, left_out: tuple[str, ...] = LEFT_OUT, shares: int | None = None, folders: int = FOLDERS) -> DataFrame:
    """(path, size) of all files below ``root``, paths relative to it, listed in rounds.

    A task lists ``folders`` folders at most; those that are left are dealt anew over all tasks, so that one
    deep or wide folder is listed by many. Each round is a table, so a lost executor repeats no other.
    """
    register(spark)
    shares = shares or 2 * spark.sparkContext.defaultParallelism
    names = frozenset(n.lower() for n in left_out)
    reader = spark.read.format("pruned_trees").option("leftout", ",".join(left_out)).option("shares", shares).option("folders", folders)
    rounds = [materialize(reader.load(root))]

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            yield from walk(root, one.column(0).to_pylist(), names, folders)

    while not (left := rounds[-1].where("is_open")).isEmpty():
        with shipped():
            rounds.append(materialize(left.select("path").repartition(shares, "path").mapInArrow(deeper, SCHEMA)))
    found = rounds[0]
    for one in rounds[1:]:
        found = found.unionByName(one)
    return found.where(~F.col("is_open")).select("path", "size")


def loaded(files: store.FileSystem, paths: list[str]) -> Iterator[tuple[int, bytes]]:
    for i, path in enumerate(paths):
        with files.open_input_stream(path) as stream:
            yield i, stream.read()


def read_contents(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Batches with a ``tree_path`` column, cut so that contents stay within bounds, with ``bytes`` as the last column."""
    files, base = located(root)
    for one in batches:
        paths = [posixpath.join(base, p) for p in one.column(one.schema.get_field_index("tree_path")).to_pylist()]
        start, held, size = 0, [], 0
        for i, content in loaded(files, paths):
            held.append(content)
            size += len(content)
            if size >= BATCH_BYTES or i + 1 == len(paths):
                part = one.slice(start, len(held))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*one.schema.names, "bytes"])
                start, held, size = i + 1, [], 0


def digests(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """The same rows with the SHA-256 of each file's bytes in the place of contents, read in pieces."""
    files, base = located(root)
    for one in batches:
        found = []
        for path in one.column(one.schema.get_field_index("tree_path")).to_pylist():
            digest = hashlib.sha256()
            with files.open_input_stream(posixpath.join(base, path)) as stream:
                while piece := stream.read(1 << 20):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*one.columns, pa.array(found, pa.string())], [*one.schema.names, "digest"])


def spread(files: DataFrame) -> DataFrame:
    """``files`` (..., size) over as many tasks as their bytes ask for, since rows of paths say nothing about them."""
    total = files.agg(F.sum("size")).first()[0] or 0
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))


def with_contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` (tree_path, ...) with ``bytes``, read where the rows lie; only the files that are there are opened."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read_contents(batches, root)

    with shipped():
        return files.mapInArrow(read, StructType([*files.schema, StructField("bytes", BinaryType())]))


def with_digests(files: DataFrame, root: str) -> DataFrame:
    """``files`` (tree_path, ...) with ``digest``, the SHA-256 of each file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digests(batches, root)

    with shipped():
        return files.mapInArrow(read, StructType([*files.schema, StructField("digest", StringType())]))


def write_files(files: DataFrame, root: str) -> int:
    """Write ``files`` (tree_path, content) below ``root``, texts in UTF-8; returns how many there are."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, base = located(root)
        made: set[str] = set()
        for one in batches:
            for path, content in zip(one.column(0).to_pylist(), one.column(1), strict=True):
                target = posixpath.join(base, path)
                folder = posixpath.dirname(target)
                if folder not in made:
                    out.create_dir(folder, recursive=True)
                    made.add(folder)
                with out.open_output_stream(target) as stream:
                    stream.write((content.as_py() or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([one.num_rows], pa.int64())], ["n"])

    with shipped():
        return files.select("tree_path", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def list_repos(spark: SparkSession, root: str, **options) -> DataFrame:
    """(repo_id, path, tree_path, size) of the files below ``root/<repo_id>/``, without folders that are left out."""
    listed = list_tree(spark, root, **options).where(F.contains("path", F.lit("/")))
    return listed.select(
        F.substring_index("path", "/", 1).alias("repo_id"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), F.col("path").alias("tree_path"), "size"
    )
