"""WARC archives as chunked record tables.

Writing is JVM-side: a record is some consecutive rows of a text table with CRLF after each, so any file system that
Spark writes to holds the archives, under its commit protocol. The first row is the headers; a payload above
``chunk_bytes`` follows in HTTP chunks, a row each, so no record is ever put together as a whole. The payload itself is
one value of the input, which Spark holds as it reads it.

Reading streams: the archives are gzip files, so one task reads one file in order, line by line, and a parser emits
rows of a record's identifier, chunk number, bytes and the SHA-1 of all bytes so far. Neither it nor the rows ever
hold a whole payload; a record's length and digest are those of its last chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import scratch_path

CHUNK_BYTES, REVISIT_BYTES = 65_536, 1000
END = "\r\n\r\n"
#: Rows (lines and chunks) that the parser hands on at a time, in bytes.
BATCH_BYTES = 1 << 20


def revisits(pages: DataFrame, id_col: str, payload: Column, at_least: int) -> DataFrame:
    """``pages`` with _payload, _bytes, _digest and _first: of equal payloads of ``at_least`` bytes the largest id.

    Equality is that of SHA-256 and length. It is settled on ids and hashes alone; then each payload is joined once, by
    its id and hash, so a payload that very many pages have isn't a hot key.
    """
    key = F.sha2("_payload", 256)
    keys = pages.select(F.col(id_col).alias("_id"), payload.alias("_payload")).where(F.octet_length("_payload") >= at_least).select("_id", key.alias("_key"))
    largest = keys.groupBy("_key").agg(F.max("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_first")
    again = keys.join(largest.hint("merge"), "_key").where("_first > _id").select("_id", "_key", "_first").distinct()
    rows = pages.withColumn("_payload", payload).withColumns({"_bytes": F.octet_length("_payload").cast("long"), "_digest": F.sha1("_payload"), "_key": key})
    return rows.join(again.hint("merge"), (F.col(id_col) == F.col("_id")) & (rows["_key"] == again["_key"]), "left").drop("_id").drop(again["_key"])


def record_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_least: int = REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows of archives, in order, each to be ended by CRLF."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = revisits(pages.select(F.col(id_col), F.col(url_col), F.col(html_col)), id_col, payload, at_least)
    again = F.col("_first").isNotNull()
    # A string id may hold anything: it is percent-encoded. A target that would break the header is, too.
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(c.cast("string")), F.lit("")), F.lit(">"))
    url = F.coalesce(F.regexp_replace(F.col(url_col), "[\\x00-\\x20\\x7F]", "%20"), F.lit(""))
    target = F.when(F.length(url) > 0, F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))).otherwise("")
    size = F.col("_bytes")
    chunked = (size > chunk_bytes) & ~again
    count, rest = F.ceil(size / chunk_bytes), size % chunk_bytes
    one = lambda n: F.length(F.hex(n)) + 4 + n
    body = F.when(again, 0).when(chunked, F.floor(size / chunk_bytes) * one(F.lit(chunk_bytes)) + F.when(rest > 0, one(rest)).otherwise(0) + 5).otherwise(size)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(chunked, F.lit("Transfer-Encoding: chunked\r\n")).otherwise(F.concat(F.lit("Content-Length: "), size.cast("string"), F.lit("\r\n"))))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col(id_col)), F.lit(f"\r\nWARC-Date: {date}\r\n"), target,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest"), F.lit("\r\n"),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("_first")), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.length(http) + 2 + body).cast("string"), F.lit(END), http,
    )
    # Row 0 is the headers; then come the chunks, and what ends chunks and record; or a whole short payload.
    last = F.when(chunked, count + 1).otherwise(F.lit(1).cast("long"))
    steps = rows.withColumn("_last", last).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    i = F.col("_i")
    piece = F.substring(F.col("_payload"), ((i - 1) * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    line = F.when(i == 0, head).when(again, F.lit("\r\n")).when(~chunked, F.concat(F.col("_payload").cast("string"), F.lit("\r\n"))).when(i == F.col("_last"), F.lit("0\r\n\r\n\r\n")).otherwise(F.concat(F.hex(F.octet_length(piece).cast("long")), F.lit("\r\n"), piece.cast("string")))
    return steps.select(line.alias("value"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Write gzip archives (``part-*.txt.gz``) to ``path``; see record_lines for the options."""
    record_lines(pages, **options).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class Parser:
    """WARC bytes, fed in lines of any size, to chunk rows. Holds a header or a part of one chunk at a time."""

    def __init__(self, chunk_bytes: int, with_data: bool):
        self.size, self.with_data = chunk_bytes, with_data
        self.rows: list[tuple] = []
        self._begin()

    def _begin(self) -> None:
        self.state, self.head, self.http, self.left, self.chunk_left = "start", {}, {}, 0, 0

    def feed(self, line: bytes) -> None:
        """``line`` includes the newline that ended it."""
        at = 0
        while at < len(line):
            if self.state in ("start", "head", "http", "size", "trailer"):
                said = line[at:].rstrip(b"\r\n").decode("utf-8", "replace")
                if self.state in ("http", "size", "trailer"):
                    self.left -= len(line) - at
                at = len(line)
                self._header(said)
            else:  # payload bytes
                most = min(len(line) - at, self.left) if self.state == "plain" else min(len(line) - at, self.left, self.chunk_left)
                self._payload(line[at : at + most])
                at += most
                self.left -= most
                if self.state == "plain" and not self.left:
                    self._finish()
                elif self.state == "chunk":
                    self.chunk_left -= most
                    if not self.chunk_left:
                        self.state = "size"  # the line break after a chunk is an empty line there

    def _header(self, said: str) -> None:
        if self.state == "start":
            if said.startswith("WARC/"):
                self.state = "head"
        elif self.state in ("head", "http"):
            if said:
                key, _, value = said.partition(":")
                (self.head if self.state == "head" else self.http)[key.strip().lower()] = value.strip()
            elif self.state == "head":
                self.left, self.state = int(self.head["content-length"]), "http"
            else:
                self.sha, self.total, self.number, self.filled, self.buffer = hashlib.sha1(), 0, 0, 0, bytearray()
                chunked = self.http.get("transfer-encoding", "").lower() == "chunked"
                self.state = "size" if chunked else "plain"
                if not chunked and not self.left:
                    self._finish()
        elif self.state == "size":
            if said:
                self.chunk_left = int(said, 16)
                self.state = "chunk" if self.chunk_left else "trailer"
        elif self.state == "trailer" and not self.left:
            self._finish()

    def _payload(self, part: bytes) -> None:
        while part:
            if self.filled == self.size:
                self._row(False)
            take = part[: self.size - self.filled]
            part = part[len(take) :]
            self.sha.update(take)
            self.total += len(take)
            self.filled += len(take)
            if self.with_data:
                self.buffer += take

    def _row(self, last: bool) -> None:
        kind = self.head.get("warc-type", "")
        revisit = kind == "revisit"
        digest = self.head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else self.sha.hexdigest()
        size = int(self.http.get("content-length", 0)) if revisit else self.total
        self.rows.append((self.head.get("warc-record-id"), self.number, last, size, digest, kind, self.head.get("warc-refers-to"), self.head.get("warc-target-uri"), bytes(self.buffer) if self.with_data else None))
        self.number, self.filled = self.number + 1, 0
        self.buffer.clear()

    def _finish(self) -> None:
        self._row(True)
        self._begin()


#: The chunked record table. bytes_so_far and sha1_so_far are of the payload up to and with the chunk.
SCHEMA = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int64()), ("is_last", pa.bool_()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("data", pa.binary())])
DDL = "record_id string, chunk_no long, is_last boolean, bytes_so_far long, sha1_so_far string, record_type string, refers_to string, url string, data binary"


def read(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of gzip archives in ``path``. A record has one chunk at least, also if it is empty.

    A revisit has no payload of its own: its one row has the length and digest that its headers give.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(chunk_bytes, with_data)
        held = 0
        for batch in batches:
            for line in batch.column(0):
                line = line.as_buffer().to_pybytes() + b"\n"
                parser.feed(line)
                held += len(line)
                if held > BATCH_BYTES and parser.rows:
                    yield _batch(parser.rows)
                    parser.rows, held = [], 0
        if parser.rows:
            yield _batch(parser.rows)

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(run, DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def page_of(record: Column, kind: str) -> Column:
    """The page id in a record id."""
    return F.nullif(F.url_decode(F.regexp_extract(record, "^<urn:page:(.*)>$", 1)), F.lit("")).cast(kind)


def archive_roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` as archives, read them back: page id, payload_bytes, payload_digest, record_type, refers_to.

    One row comes back for each row written. Of equal payloads of at least REVISIT_BYTES bytes the record with the
    largest id is a response, and so is each other row with that id or without an id; the rest are revisits. A null
    html is an empty payload, a null url leaves out the target; other columns are ignored. An empty string id comes back
    as null; an empty table gives an empty one.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, chunk_bytes=chunk_bytes)
    kind = pages.schema[id_col].dataType.simpleString()
    last = read(pages.sparkSession, path, chunk_bytes, with_data=False).where("is_last")
    return last.select(page_of(F.col("record_id"), kind).alias(id_col), F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", page_of(F.col("refers_to"), kind).alias("refers_to"))
