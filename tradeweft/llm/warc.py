"""WARC archives of pages, written and read as rows of bounded size.

Writing: a payload is cut into chunks of ``CHUNK`` bytes or less at character bounds; each chunk is a
row with the record's id, the chunk number, and the size and SHA-1 of the payload so far. A record is
an HTTP response in chunked transfer coding, so that every chunk is a line of its own and no record
is ever put together in memory; Spark's text writer ends lines with CR LF, as the format asks.
Archives are compressed with gzip, which Spark doesn't split, so one task reads a file's lines in
order, through a small state machine that gives the chunk rows again; the digest of a record is that
of its last chunk.

Of payloads of ``LEAST`` bytes or more with one digest and size, the page with the largest page_id is
the response and the others are revisits of it; smaller payloads are all responses.

A record is named by its page_id; where several rows have one page_id, a number of the row follows, so
that each row stays a record of its own (a revisit then refers to its page, not to one of the rows).

Defined results: null html is an empty payload; rows without page_id take no part; repeated rows and
rows of one page_id with other payloads are records each; a null url is written as an empty one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeweft.session import scratch_dir

CHUNK, LEAST = 64 * 1024, 1000
_END = b"\r\n"
_CHUNKS = "page_id long, number long, chunk int, data binary, bytes_so_far long, sha1_so_far string, record_type string, refers_to long"


def chunked(payload: bytes, size: int = CHUNK) -> Iterator[memoryview]:
    """Views of the payload of at most ``size`` bytes that end between characters."""
    view, at = memoryview(payload), 0
    while at < len(view):
        end = min(at + size, len(view))
        while end < len(view) and view[end] & 0xC0 == 0x80:
            end -= 1
        yield view[at:end]
        at = end


def decide(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page."""
    html = F.coalesce("html", F.lit(""))
    sized = (pages.where(F.col("page_id").isNotNull())
             .select("page_id", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest")))
    groups = (sized.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest", "payload_bytes")
              .agg(F.max("page_id").alias("first")))
    other = F.col("first").isNotNull() & (F.col("first") != F.col("page_id"))
    return sized.join(groups, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "payload_bytes", "payload_digest", F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("first")).alias("refers_to"))


def _name(page: int, number: int | None) -> str:
    return f"<urn:page:{page}>" if number is None else f"<urn:page:{page}:{number}>"


def _named(name: str) -> tuple[int, int | None]:
    page, _, number = name[10:-1].partition(":")
    return int(page), int(number) if number else None


def _head(row: dict, url: str, payload: bytes) -> tuple[bytes, list[memoryview]]:
    """The lines up to the payload, and the payload's chunks (none for a revisit)."""
    views = list(chunked(payload)) if row["record_type"] == "response" else []
    sha1 = hashlib.sha1()
    for view in chunked(payload):
        sha1.update(view)
    http = _END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Transfer-Encoding: chunked", b"", b""])
    framed = sum(len(b"%x" % len(v)) + len(v) + 4 for v in views) + 5
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'], row['number'])}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}",
             f"WARC-Payload-Digest: sha1:{sha1.hexdigest()}", f"X-Payload-Length: {len(payload)}",
             *([f"WARC-Refers-To: {_name(row['refers_to'], None)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
               if row["record_type"] == "revisit" else []),
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + framed}", ""]
    return "\r\n".join(lines).encode() + _END + http[:-2], views


def write_archives(pages: DataFrame, out: str) -> None:
    """Write a record for every page under ``out``."""
    chosen = decide(pages).groupBy("page_id", "payload_digest", "record_type", "refers_to").agg(F.count(F.lit(1)).alias("n"))
    chosen = chosen.withColumn("alone", F.sum("n").over(Window.partitionBy("page_id")) == 1).drop("n")
    html = F.coalesce("html", F.lit(""))
    rows = (pages.where(F.col("page_id").isNotNull())
            .select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("payload_digest"))
            .join(chosen, ["page_id", "payload_digest"]).select(
                "page_id", F.when(~F.col("alone"), F.monotonically_increasing_id()).alias("number"), "url", "html", "record_type", "refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines: list = []
            held = 0
            keys = batch.select(["page_id", "number", "record_type", "refers_to"]).to_pylist()
            for row, url, html in zip(keys, batch.column("url"), batch.column("html")):
                head, views = _head(row, url.as_py(), html.as_buffer())
                lines.append(head)
                for view in views:
                    lines += [b"%x" % len(view), bytes(view)]
                    held += len(view)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], ["value"])
                        lines, held = [], 0
                lines += [b"0", b"", b"", b""]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], ["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").text(out)


class _Reader:
    """State machine over the lines of one archive file."""

    def __init__(self):
        self.state, self.head, self.rows = "start", {}, []

    def _put(self, data: bytes) -> None:
        self.size += len(data)
        self.sha1.update(data)
        self.rows.append((self.page, self.number, self.chunk, data, self.size, self.sha1.hexdigest(), self.head["warc-type"], self.refers))
        self.chunk += 1

    def line(self, line: bytes) -> None:
        if self.state == "start":
            if line.startswith(b"WARC/"):
                self.state, self.head = "head", {}
        elif self.state == "head":
            if line:
                name, _, value = line.decode().partition(": ")
                self.head[name.lower()] = value
                return
            self.page, self.number = _named(self.head["warc-record-id"])
            self.refers = _named(self.head["warc-refers-to"])[0] if "warc-refers-to" in self.head else None
            self.size, self.chunk, self.sha1, self.state = 0, 0, hashlib.sha1(), "http"
        elif self.state == "http":
            if not line:
                self.state = "size"
        elif self.state == "size":
            self.left, self.parts, self.state = int(line, 16), [], "data"
            if not self.left:
                if not self.chunk:  # a revisit, or an empty payload: a row without data
                    self.rows.append((self.page, self.number, 0, b"", int(self.head["x-payload-length"]),
                                      self.head["warc-payload-digest"][5:], self.head["warc-type"], self.refers))
                elif self.sha1.hexdigest() != self.head["warc-payload-digest"][5:]:
                    raise ValueError(f"digest of page {self.page} does not match")
                self.state = "start"
        else:  # a chunk may hold line ends of its own: ``left`` is what its next lines still have to give
            self.parts.append(line)
            self.left -= len(line)
            if self.left:
                self.left -= 2  # the line end itself; at 0 an empty line still follows
            else:
                self._put(_END.join(self.parts))
                self.state = "size"


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunk rows of every record under ``out``, with the size and digest so far."""
    ordered = spark.read.option("lineSep", "\r\n").text(out).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file = _Reader(), None
        for batch in batches:
            for name, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if name != file:
                    file, rows = name, reader.rows
                    reader = _Reader()
                    reader.rows = rows
                reader.line(value)
            if reader.rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*reader.rows), (
                    pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
                reader.rows = []
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _CHUNKS.split(", ")])

    return ordered.mapInArrow(run, _CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row for each record: what its last chunk has carried along."""
    last = F.max_by(F.struct("bytes_so_far", "sha1_so_far", "record_type", "refers_to"), "chunk").alias("last")
    return chunks.groupBy("page_id", "number").agg(last).select(
        "page_id", F.col("last.bytes_so_far").alias("payload_bytes"), F.col("last.sha1_so_far").alias("payload_digest"),
        F.col("last.record_type").alias("record_type"), F.col("last.refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to a new folder in the shared scratch folder; the records read back."""
    out = f"{scratch_dir(pages.sparkSession)}/tradeweft/warc-{uuid.uuid4().hex}"
    write_archives(pages, out)
    return records(read_chunks(pages.sparkSession, out))
