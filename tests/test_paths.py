"""Normalized paths against plain ones."""

import posixpath
import random

from pyspark.sql import functions as F

from toolguard.operators import attach


def plain(path):
    text = path.replace("\\", "/")
    normal = posixpath.normpath(text) if text else ""
    normal = "/" + normal.lstrip("/") if text.startswith("/") else normal
    return "" if normal == "." else normal


def test_paths_against_the_library(spark):
    r = random.Random(2)
    parts = ["", ".", "..", "a", "b.py", "...", ".git", "..x", "é"]
    paths = ["/".join(r.choice(parts) for _ in range(r.randrange(1, 8))) for _ in range(3000)] + ["a\\..\\b", "./lib/../src//f1.py", "../lib/../a", "a/../../b/../c"]
    frame = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
    got = {x["path"]: x["file"] for x in frame.withColumn("file", attach.normalized_path(F.col("path"))).collect()}
    assert {p: f for p, f in got.items() if f != plain(p)} == {}
