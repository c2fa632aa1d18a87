"""Token counts of whole texts by a public tokenizer's own library.

Arrow batches are cut into batches of about equal bytes. A text falls apart at
white space, where the tokenizer ends every token anyway, so long texts never meet the
library whole and a piece that was counted before is not encoded again. Only
lengths leave the task.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolguard.llm.common import by_bytes, map_arrow, texts_of

LIMIT = 2048
#: Pieces remembered in each of two generations, and the longest that is remembered.
REMEMBERED = 600_000
SHORT = 48
#: The one pre-tokenizer pattern whose pieces of printable ASCII are cut here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Memory:
    """Counts of recent pieces in two generations, so memory is bounded and frequent ones stay."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.new, self.old = most, {}, {}

    def get(self, piece: str) -> int | None:
        found = self.new.get(piece)
        if found is None and (found := self.old.get(piece)) is not None:
            self.put(piece, found)
        return found

    def put(self, piece: str, count: int) -> None:
        if len(piece) <= SHORT:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[piece] = count


class Counter:
    """Counts tokens of texts by their pieces between white space.

    ``encode`` gives the numbers of tokens of many pieces, ``quick`` that of one piece or
    None. Without ``split`` whole texts are encoded: for tokenizers that keep white space.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], list[int]],
        split: str | None = r"[ \t\n\r\x0b\x0c]+",
        quick: Callable[[str], int | None] | None = None,
    ):
        self.encode, self.quick, self.memory = encode, quick, Memory()
        self.split = None if split is None else re.compile(split).split

    def counts(self, texts: list[str]) -> list[int]:
        if self.split is None:
            return self.encode(texts)
        totals, get = [], self.memory.get
        left: dict[str, list[int]] = {}  # pieces for the library, with the texts that hold them
        for i, text in enumerate(texts):
            total = 0
            for piece in self.split(text):
                n = get(piece)
                if n is None:
                    n = self.quick(piece) if self.quick else None
                    if n is None:
                        left.setdefault(piece, []).append(i)
                        continue
                    self.memory.put(piece, n)
                total += n
            totals.append(total)
        for pieces in _batches(list(left), 1 << 20):  # the library's objects don't pile up
            for piece, n in zip(pieces, self.encode(pieces), strict=True):
                self.memory.put(piece, n)
                for i in left[piece]:
                    totals[i] += n
        return totals


def _batches(pieces: list[str], limit: int) -> Iterator[list[str]]:
    batch, held = [], 0
    for piece in pieces:
        batch.append(piece)
        held += len(piece) + 16
        if held > limit:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def tokenizers_counter(path: str) -> Counter:
    """By the ``tokenizers`` library."""
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(pieces: list[str]) -> list[int]:
        return [len(x.ids) for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    # Only where white space is dropped do pieces add up to the whole.
    joined, a, b, wide, blank = encode(["a b", "a", "b", "a \n b", " "])
    if not (joined == wide == a + b and blank == 0):
        return Counter(encode, None)
    cut = (json.loads(tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    if cut[0].get("pattern") != {"Regex": PATTERN}:
        return Counter(encode)
    # Printable ASCII without contractions and special strings: lower case, no other
    # normal form, bytes stand for themselves. The model is the library's.
    plain, parts, model, known = re.compile(r"[!-&(-;=-~]+").fullmatch, re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+").findall, tokenizer.model, Memory()

    def quick(piece: str) -> int | None:
        if not plain(piece):
            return None
        total = 0
        for part in parts(piece.lower()):
            n = known.get(part)
            if n is None:
                n = len(model.tokenize(part))
                known.put(part, n)
            total += n
        return total

    return Counter(encode, quick=quick)


def sentencepiece_counter(path: str) -> Counter:
    """By the ``sentencepiece`` library; texts whole."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return Counter(lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)], None)


def _counter(name: str) -> Counter:
    """A worker's counter: kept with the process, which Spark uses for task after task."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
    kept = sys.modules.setdefault("_toolguard_counters", types.ModuleType("_toolguard_counters")).__dict__
    if name not in kept:
        path = public_tokenizers.path(name)
        kept[name] = tokenizers_counter(path) if name.endswith(".json") else sentencepiece_counter(path)
    return kept[name]


def count_tokens(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``name`` is a file of the installed tokenizers. NULL and empty texts have no tokens
    and no bytes; ids may be NULL or repeated; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name)
        for batch in by_bytes(batches, "text"):
            found = counter.counts(list(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    counted = map_arrow(rows, count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
