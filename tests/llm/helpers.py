"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use inside under the same names.
CLASHING = "fp long, key long, size long, rate double, score double, label int, n_hit long, k1 long, w string, word string, copy int"


def sentences(n: int, seed: int = 1, words: int = 60) -> list[str]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    return [" ".join(r.choices(vocabulary, k=r.randint(3, words))) + "." for _ in range(n)]


def awkward(spark, extra: list[tuple] = ()):
    """Documents with NULLs in every column, empty, blank and long texts, repeats and clashing columns."""
    texts = sentences(30)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [
        (100, texts[0], "en", "s0", 1), (101, texts[0].upper(), None, None, None), (None, texts[3], "de", "s1", 1), (None, None, None, None, None),
        (102, "", "en", "s2", 0), (103, " \t\n ", "en", "s2", 4), (104, None, "en", "s2", None),
        (5, texts[5], "en", "s1", len(texts[5])), (5, texts[5], "en", "s1", len(texts[5])),
        (105, " ".join(sentences(1, seed=9, words=5000) * 9), "en", "é", 1), (106, "ÀÉ Straße 🙂   x" * 3, "fr", "s1", 1),
    ]
    rows += list(extra)
    frame = spark.createDataFrame(rows, DOCS)
    for column in CLASHING.split(", "):
        name, kind = column.split()
        frame = frame.selectExpr("*", f"cast(7 as {kind}) as {name}")
    return frame, rows


def empty(spark, schema: str = DOCS):
    return spark.createDataFrame([], schema)
