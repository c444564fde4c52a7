"""WARC archives: written a gzip member a record, read back in sequence.

A response record holds a page's payload behind an HTTP header; a page whose payload another one has
already is a revisit, which names that one and holds the HTTP header alone. Records carry digests of
their block and of the payload (SHA-1, base 32).

The reader streams an archive: it inflates one gzip member at a time from chunks as they come, frames
the record by its Content-Length, hashes as it goes and compares. Archives lie in the folder that all
executors share; a writer's task reports its archives through Spark's own commit, so what a lost or
repeated attempt has left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, staged, staging_dir

#: A task begins a new archive once one has so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Bytes read at a time, and of payloads sent on at a time.
CHUNK, BATCH_BYTES = 1 << 18, 8 << 20
#: Bytes of a record's or a response's header at most.
HEADER_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids: the page's own number, and a row's place in the table for pages without one.
PAGE_URN = "urn:page:"
EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(text: str) -> str:
    """text without what can't stand in a header: controls and blanks as percent signs and digits."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(kind: str, uri: str | None, page: str, payload: bytes, digest: str, refers_to: str | None = None, date: str = EPOCH) -> bytes:
    """A WARC record as one gzip member. payload is that of a revisit too, whose block ends before it."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{page}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_uri(uri)}")
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    member = zlib.compressobj(wbits=31)
    return member.compress("\r\n".join(head).encode()) + member.compress(block + b"\r\n\r\n") + member.flush()


class Record(NamedTuple):
    """A record as read. problem says what is wrong with it, None if all agrees."""

    offset: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes
    problem: str | None


class _Framer:
    """Takes the bytes of one inflated member as they come: header, block of Content-Length, end."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.headers: dict[str, str] = {}
        self.http: dict[str, str] = {}
        self.left: int | None = None
        self.in_http = False
        self.payload: list[bytes] = []
        self.block_sha, self.payload_sha = hashlib.sha1(), hashlib.sha1()
        self.tail = b""
        self.problem: str | None = None

    def feed(self, data: bytes) -> None:
        if self.problem:
            return
        if self.left is None:
            self.held += data
            end = self.held.find(b"\r\n\r\n")
            if end < 0:
                if len(self.held) > HEADER_BYTES:
                    self.problem = "header"
                return
            first, self.headers = _fields(bytes(self.held[:end]))
            length = self.headers.get("content-length", "")
            if not first.startswith("WARC/") or not (length.isascii() and length.isdigit()):
                self.problem = "header"
                return
            self.left, self.in_http = int(length), self.headers.get("content-type", "").startswith("application/http")
            data, self.held = bytes(self.held[end + 4 :]), bytearray()
        part = data[: self.left]
        self.left -= len(part)
        self.block_sha.update(part)
        self.tail += data[len(part) :][: 5 - len(self.tail)]
        if self.in_http:
            self.held += part
            end = self.held.find(b"\r\n\r\n")
            if end < 0:
                if len(self.held) > HEADER_BYTES:
                    self.problem = "http"
                return
            self.http = _fields(bytes(self.held[:end]))[1]
            part, self.held, self.in_http = bytes(self.held[end + 4 :]), bytearray(), False
        self.payload_sha.update(part)
        self.payload.append(part)

    def ended(self, offset: int, torn: bool) -> Record:
        problem = self.problem or ("torn" if torn or self.left is None or self.left else "http" if self.in_http else None)
        problem = problem or ("length" if self.tail != b"\r\n\r\n" else None)
        if not problem and self._differs("warc-block-digest", self.block_sha):
            problem = "block digest"
        if not problem and self.headers.get("warc-type") != "revisit" and self._differs("warc-payload-digest", self.payload_sha):
            problem = "payload digest"
        return Record(offset, self.headers, self.http, b"".join(self.payload), problem)

    def _differs(self, name: str, sha: hashlib._Hash) -> bool:
        said = self.headers.get(name)
        return said is not None and said.startswith("sha1:") and said[5:] != base64.b32encode(sha.digest()).decode()


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line, and fields by their names in lower case."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    split = (line.partition(":") for line in lines)
    return first, {name.strip().lower(): value.strip() for name, _, value in split}


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """Records of an archive, in sequence: memory for one at a time. What is no gzip member, or breaks
    off, gives a record with a problem, and reading goes on at the next member's beginning."""
    rest, offset = b"", 0
    while True:
        if not rest:
            rest = stream.read(CHUNK)
            if not rest:
                return
        member, frame, begun, torn = zlib.decompressobj(wbits=31), _Framer(), offset, False
        try:
            while True:
                offset += len(rest)
                frame.feed(member.decompress(rest))
                if member.eof:
                    break
                rest = stream.read(CHUNK)
                if not rest:
                    torn = True
                    break
            rest = member.unused_data
            offset -= len(rest)
            yield frame.ended(begun, torn)
        except zlib.error:
            yield frame.ended(begun, True)
            offset -= len(rest)
            skip = 1 if offset == begun else 0
            while (at := rest.find(b"\x1f\x8b\x08", skip)) < 0:
                offset += max(len(rest) - 2, 0)
                more = stream.read(CHUNK)
                if not more:
                    return
                rest, skip = rest[-2:] + more, 0
            rest, offset = rest[at:], offset + at


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, by its address, and the folder's path on it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def roles(pages: DataFrame) -> DataFrame:
    """Columns of pages (page_id, url, html) with digest, first: the smallest page_id of those with an
    equal payload, and kind: `response` for that page, `revisit` for the others.

    The smallest is sought over keys alone (a digest, an id and the row's place in its file); payloads are
    joined once to those digests that come twice or more, hot ones dealt over salts.
    """
    try:
        pages.select("_metadata.row_index").schema  # noqa: B018
    except AnalysisException:  # a frame that comes from no file: it needs one for its rows to have a place
        pages = staged(pages.select("page_id", "url", "html"), "pages")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("place"),
    )
    keys = staged(rows.select("page_id", "digest", "place"), "keys")
    first = F.min(F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "place"))
    copied = keys.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = spread_join(rows, copied, "digest", "left", like=keys)
    is_first = F.col("first").isNull() | (F.col("first.place") == F.col("place"))
    return met.withColumn("kind", F.when(is_first, "response").otherwise("revisit"))


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of pages (page_id, url, html), a record a row: (path, records, bytes) of each archive.

    folder (one that pyarrow's file systems can open by its address) is by default the shared one of the
    session. A NULL html is an empty payload, and a payload like any other: equal to other empty ones; a
    NULL url has no target address in its record; a page without an id is named by its row's place and
    comes after all others, so it is never preferred as the response. Of rows repeated in id and payload
    one is the response and the others revisit it. Very long pages are records like others; no pages make
    no archives; further columns are left out, whatever their names.
    """
    spark = pages.sparkSession
    folder = f"{folder or staging_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        done, out, n, size = [], None, 0, 0
        for b in batches:
            for r in zip(*(b.column(c) for c in b.schema.names), strict=True):
                page, url, payload, digest, kind, refers = (x.as_py() for x in r)
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                data = record(kind, url, page, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (path, n, size)], None
        if out is not None:
            out.close()
            done.append((path, n, size))
        name = [f"{folder}/{p.rsplit('/', 1)[1]}" for p, _, _ in done]
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], ["path", "records", "bytes"])

    urn = lambda page, place: F.concat(F.lit(PAGE_URN), F.coalesce(page.cast("string"), F.concat(F.lit("row:"), F.sha1(place.cast("string").cast("binary")))))
    rows = roles(pages).select(
        urn(F.col("page_id"), F.col("place")).alias("page"), "url", "payload", "digest", "kind",
        F.when(F.col("kind") == "revisit", urn(F.col("first.page_id"), F.col("first.place"))).alias("refers"),
    )
    return staged(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """Records of archives (path): path, offset, record_type, record_id, url, payload_digest, payload_bytes,
    payload, refers_to, problem.

    Each archive is one task's stream. payload_bytes is the whole payload's: of a revisit, as its HTTP
    header says; its payload is empty. payload_digest is bare, and of a response without a problem it is
    that of the bytes read. A record that is torn or whose length or digest disagrees has its problem
    named and the rest is read on; an archive that can't be opened is an error.
    """
    schema = (
        "path string, offset long, record_type string, record_id string, url string, payload_digest string, payload_bytes long, "
        "payload binary, refers_to string, problem string"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]

    def row(path: str, r: Record) -> tuple:
        said, length = r.headers, r.http.get("content-length", "")
        revisit = said.get("warc-type") == "revisit"
        bare = lambda name: said[name].strip("<>") if name in said else None
        return (
            path, r.offset, said.get("warc-type"), bare("warc-record-id"), said.get("warc-target-uri"),
            said.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            int(length) if revisit and length.isdigit() else len(r.payload), r.payload, bare("warc-refers-to"), r.problem,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            for path in b.column("path").to_pylist():
                system, at = _open(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append(row(path, r))
                        size += len(r.payload) + 500
                        if size > BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    paths = archives.select("path")
    return paths.repartition(max(paths.count(), 1)).mapInArrow(run, schema)  # dealt in turn: an archive a task


def page_records(records: DataFrame) -> DataFrame:
    """records with page_id and refers_to as the numbers that record ids hold; NULL for other ids."""
    number = lambda c: F.regexp_extract(c, rf"^{PAGE_URN}(-?\d+)$", 1)
    found = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return records.withColumn("page_id", found(F.col("record_id"))).withColumn("refers_to", found(F.col("refers_to")))


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """read() of archives from anywhere, by their addresses."""
    return read(spark.createDataFrame([(p,) for p in paths], "path string"))


#: SQL of the records read back: digests are built from hexadecimal ones, five bits a letter.
ORACLE = """
WITH p AS (SELECT page_id, row_number() OVER () AS r, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, r, octet_length(b) AS n, sha1(b) AS hex FROM p),
d AS (
  SELECT page_id, r, n, array_to_string(list_transform(range(8), lambda k: (
    list_transform([('0x' || substr(hex, 5 * k::INTEGER + 1, 5))::INTEGER], lambda v:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)))[1]), '') AS digest FROM h),
f AS (SELECT *, first_value(r) OVER w AS first_r, first_value(page_id) OVER w AS first_id FROM d WINDOW w AS (PARTITION BY digest ORDER BY page_id NULLS LAST, r))
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r <> first_r THEN first_id END AS refers_to
FROM f
"""
