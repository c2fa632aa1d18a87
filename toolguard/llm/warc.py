"""Web archives: records written from pages, and read back by boundary-chain verification.

Archives are gzip files in a folder that all executors share, written and read by Spark's own text
source. A reading task streams one archive and cuts it at every place that looks like
the start of a record. Each such candidate gives the offset of its successor, which its
length field declares. Candidates whose successors follow on directly form a run. Pointer
jumping over the runs, from the start of each file, retains the reachable ones: what looks
like a record inside a payload is never reached.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolguard.llm.common import map_arrow
from toolguard.scale import materialize, scratch

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 50_000
ID = "<urn:page:{}>"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: groups of 5 hex digits are 4 digits to the base of 32."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, n, digest, record_type, refers_to).

    Of pages with equal payloads of ``least_bytes`` or more the one with the largest id is a
    response, the others revisit it. Repeats of its row are responses too, a NULL id is below all
    others, and pages of NULL ids alone are all responses.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").alias("n"), base32_sha1(F.col("payload").cast("binary")).alias("digest")
    )
    groups = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("times"))
    groups = materialize(groups.where(F.col("times") > 1).select(F.col("digest").alias("group"), "last"))
    revisit = (F.col("n") >= least_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.join(groups, rows["digest"] == groups["group"], "left").select(
        "page_id", "url", "payload", "n", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def record(row: DataFrame) -> Column:
    """The text of a record, up to the blank lines at its end."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END)
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), page_urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            page_urn(F.col("refers_to")),
        )).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(END), block,
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; other columns are ignored); a NULL html is an empty payload.

    Control characters and blanks of a URL become %20.
    """
    rows = deduplicated(pages, least_bytes)
    rows.select(record(rows).alias("value")).write.option("compression", "gzip").option("lineSep", END).option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


@dataclass
class Candidate:
    """What looks like a record, while its block is still being read."""

    start: int
    next: int
    head: int
    fields: dict[str, str]
    left: int
    header: bytearray | None
    digest: object = field(default_factory=hashlib.sha1)
    size: int = 0

    def feed(self, data: bytes) -> None:
        data = data[: self.left]
        self.left -= len(data)
        if self.header is not None:  # the block's own HTTP header is not payload
            seen = max(len(self.header) - 3, 0)  # the end may lie across two pieces
            self.header += data
            at = self.header.find(b"\r\n\r\n", seen)
            if at < 0 and self.left:
                return
            data, self.header = bytes(self.header[at + 4 if at >= 0 else 0 :]), None
        self.digest.update(data)
        self.size += len(data)

    def row(self, path: str) -> tuple:
        get = self.fields.get
        digest = base64.b32encode(self.digest.digest()).decode()
        return (path, self.head, self.start, self.next, self.left == 0, get("warc-type"), get("warc-record-id"), get("warc-refers-to"),
                get("warc-target-uri"), get("warc-payload-digest"), self.size, digest)


class Walk:
    """Candidates of one archive, chunk after chunk; a chunk is what lies between two magic lines."""

    def __init__(self, path: str):
        self.path, self.at, self.open, self.last, self.targets = path, None, [], None, set()

    def chunk(self, data: bytes) -> list[tuple]:
        """Rows of the candidates that end here."""
        if self.at is None:  # before the first magic line
            self.at = len(data)
            return []
        magic = MAGIC.encode()
        for x in self.open:
            x.feed(magic + data)
        fields, body = header_fields(data)
        if fields is not None:
            length = int(fields["content-length"])
            after = self.at + len(magic) + body + length + len(END)
            follows = self.last is not None and self.last.next == self.at and self.at not in self.targets
            if self.last is not None and self.last.next > self.at:
                self.targets.add(self.last.next)  # it is not the next candidate's: a run starts there
            new = Candidate(self.at, after, self.last.head if follows else self.at, fields, length,
                            bytearray() if fields.get("content-type", "").startswith("application/http") else None)
            new.feed(data[body:])
            self.open.append(new)
            self.targets = {t for t in self.targets if t > self.at} if len(self.targets) > 64 else self.targets
            self.last = new
        self.at += len(magic) + len(data)
        done = [x for x in self.open if not x.left]
        self.open = [x for x in self.open if x.left]
        return [x.row(self.path) for x in done]

    def end(self) -> list[tuple]:
        return [x.row(self.path) for x in self.open]


def header_fields(data: bytes) -> tuple[dict[str, str] | None, int]:
    """Lower-case named fields and where the block starts, or None if this is no record's header."""
    at = data.find(b"\r\n\r\n")
    if at < 0:
        return None, 0
    fields = {}
    for line in data[:at].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None, 0
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"[0-9]{1,15}", fields.get("content-length", "")):
        return None, 0
    return fields, at + 4


COLUMNS = (
    "file string, head long, start long, next long, complete boolean, type string, id string, refers string, uri string, "
    "declared string, payload_bytes long, payload_digest string"
)
_TYPES = (pa.string(), *[pa.int64()] * 3, pa.bool_(), *[pa.string()] * 5, pa.int64(), pa.string())


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    walk = None
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names)

    for batch in batches:
        for path, value in zip(batch.column(0), batch.column(1), strict=True):
            path = path.as_py()
            if walk is None or walk.path != path:
                rows += walk.end() if walk else []
                walk = Walk(path)
            rows += walk.chunk(value.as_py())
        yield made()
        rows = []
    if walk:
        rows = walk.end()
        yield made()


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Everything in the archives below ``path`` that looks like a record, with its successor and its run."""
    chunks = spark.read.option("lineSep", MAGIC).text(path)
    return map_arrow(chunks.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")), _candidates, COLUMNS)


def reachable(found: DataFrame) -> DataFrame:
    """(file, head) of the runs on the chain from the start of each file, by pointer jumping.

    Each round doubles the jumps; without look-alikes an archive is one run and one round is all.
    """
    jumps = materialize(found.groupBy("file", "head").agg(F.max_by("next", "start").alias("exit")))
    heads = jumps.select("file", "head")
    reached = materialize(heads.where(F.col("head") == 0))
    while True:
        ahead = jumps.select("file", "head", F.col("exit").alias("to"))
        landed = reached.join(ahead, ["file", "head"]).select("file", F.col("to").alias("head")).join(heads, ["file", "head"], "left_semi")
        reached = materialize(reached.union(landed).distinct())
        farther = jumps.select("file", F.col("head").alias("to"), F.col("exit").alias("exit2"))
        jumps = materialize(ahead.join(farther, ["file", "to"]).select("file", "head", F.col("exit2").alias("exit")))
        if jumps.isEmpty():
            return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: those on the chain of a file, and complete."""
    found = materialize(candidates(spark, path))
    return found.join(reachable(found), ["file", "head"], "left_semi").where("complete").drop("head", "complete")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row, read back from archives written of ``pages``.

    Bytes and digest of a revisit are those of the response it refers to. Repeated rows are
    records of their own. An empty table gives an archive without records and no rows.
    """
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write(pages, path, least_bytes)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    records = materialize(read(spark, path)).select(
        F.expr("nullif(regexp_extract(id, '^<urn:page:(-?[0-9]+)>$', 1), '')").cast("long").alias("page_id"),
        "id", "type", "refers", "payload_bytes", "payload_digest", F.regexp_replace("declared", "^sha1:", "").alias("declared"),
    )
    responses = records.where("type = 'response'")
    wrong = F.when(F.col("payload_digest") != F.col("declared"), F.raise_error(F.concat(F.lit("payload digest differs in "), "id")))
    originals = responses.groupBy(F.col("id").alias("of"), F.col("payload_digest").alias("full_digest")).agg(F.first("payload_bytes").alias("full_bytes"))
    revisits = records.where("type = 'revisit'")
    return responses.select(
        "page_id", "payload_bytes", F.coalesce(wrong.cast("string"), F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    ).union(
        revisits.join(originals, (F.col("refers") == F.col("of")) & (F.col("declared") == F.col("full_digest")), "left").select(
            "page_id", F.col("full_bytes"),
            F.coalesce("full_digest", F.raise_error(F.concat(F.lit("no response for the revisit "), "id")).cast("string")).alias("full_digest"),
            "type", number(F.col("refers")).cast("long"),
        )
    )
