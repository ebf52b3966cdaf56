"""WARC archives: written by tasks, read record by record.

Writing: every page becomes one record in a gzip member of its own. Pages with
equal payloads of at least ``SMALLEST`` bytes become revisits of the page with
the smallest id. Which page that is, is settled on (id, digest) pairs alone;
the payloads then meet these pairs by page id, so that no payload, however
frequent, gathers in one task.

Each task writes archives of its own into the shared folder under a name with
its attempt, and reports them; only reported archives are read, so a lost or
repeated attempt leaves nothing that counts.

Reading: one task per archive, one member at a time through incremental zlib;
the record is framed by Content-Length, and the payload's digest is verified.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import GONE_ROWS, arrow_map, new_path, rows_by_bytes, split_join, staged

#: Payloads under this many bytes are never revisits.
SMALLEST = 100
#: An archive is closed beyond this many bytes.
ROLL = 256 << 20
#: The table has no crawl time, so records carry this one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + pack.flush()


class WarcError(ValueError):
    """A record that doesn't hold what it says."""


def members(stream: BinaryIO, chunk: int = 1 << 16) -> Iterator[tuple[bytes, bool]]:
    """The content of the gzip members in pieces of ``chunk`` bytes at most, with whether a member ends; a cut-off one is an error."""
    rest = stream.read(chunk)
    while rest:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not rest:
                raise WarcError("the archive ends within a record")
            part = unpack.decompress(rest, chunk)
            rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail or stream.read(chunk)
            yield part, unpack.eof
        rest = rest or stream.read(chunk)


def parse_head(raw: bytes, at: int = 0) -> tuple[str, dict[str, str], int]:
    """(first line, fields by lower-case name, where the block begins)."""
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise WarcError("a head without an end")
    lines = raw[at:end].decode("utf-8").split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return lines[0], fields, end + 4


class Framer:
    """Checks one record as its bytes arrive; holds its heads, never its payload."""

    #: A head beyond this many bytes is an error.
    LONGEST = 1 << 20

    def __init__(self):
        self.held, self.fields, self.http = b"", None, None
        self.left = self.seen = 0
        self.hash = hashlib.sha256()

    def _head(self) -> tuple[str, dict[str, str]] | None:
        if b"\r\n\r\n" not in self.held:
            if len(self.held) > self.LONGEST:
                raise WarcError("a head without an end")
            return None
        first, fields, at = parse_head(self.held)
        self.held = self.held[at:]
        return first, fields

    def feed(self, data: bytes) -> bytes:
        """Takes bytes; returns those of the payload among them."""
        self.held += data
        if self.fields is None:
            if (got := self._head()) is None:
                return b""
            if not got[0].startswith("WARC/1."):
                raise WarcError(f"not a record: {got[0][:40]!r}")
            self.fields, self.left = got[1], int(got[1]["content-length"])
        if self.http is None:
            before = len(self.held)
            if (got := self._head()) is None:
                return b""
            self.http, self.left = got[1], self.left - (before - len(self.held))
        part, self.held = self.held[: max(self.left, 0)], self.held[max(self.left, 0) :]
        self.left -= len(part)
        self.seen += len(part)
        self.hash.update(part)
        return part

    def done(self) -> tuple[int | None, int, str, str, int | None]:
        """(page, payload bytes, digest, type, page referred to) after all checks."""
        if self.http is None or self.left != 0 or self.held != b"\r\n\r\n":
            raise WarcError("Content-Length does not frame the block")
        size, kind = int(self.http["content-length"]), self.fields["warc-type"]
        digest = self.fields["warc-payload-digest"].removeprefix("sha256:")
        refers = page_of(self.fields["warc-refers-to"]) if kind == "revisit" else None
        if kind != "revisit" and (self.seen != size or self.hash.hexdigest() != digest):
            raise WarcError("the payload is not the one that was digested")
        return page_of(self.fields["warc-record-id"]), size, digest, kind, refers


def records(stream: BinaryIO) -> Iterator[tuple[int | None, int, str, str, int | None]]:
    """Every record of an archive, verified, one gzip member after the other."""
    framer = None
    for part, last in members(stream):
        framer = framer or Framer()
        framer.feed(part)
        if last:
            yield framer.done()
            framer = None


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def with_references(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, html and the page referred to, if any."""
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    mark = F.xxhash64(body)
    total = pages.count()
    large = source.where(F.octet_length(body) >= SMALLEST).select("id", mark.alias("mark"), F.unhex(F.sha2(body, 256)).alias("digest"))
    large = staged(large, "page-digests", total)
    first = staged(large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-pages", total)
    again = split_join(large, first, ["digest"], "n", total).where("id > first").select(F.col("id").alias("again"), F.col("mark").alias("again_mark"), "first").distinct()
    again = staged(again, "revisits", total)
    few = again.count() <= GONE_ROWS
    same = (source["id"] == F.col("again")) & (mark == F.col("again_mark"))
    return source.join(F.broadcast(again) if few else again, same, "left").select("id", "url", "html", F.col("first").alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages as archives below ``folder``; returns (path, records, bytes), already done.

    A null page is an empty payload. A page without an id is written as a
    response and read back without one. Rows that repeat an id are written
    each, as what their own payload makes them; the id that others refer to is
    always a response. Pages are written whole, a few at a time however large.
    Other columns are ignored; an empty table makes no archive.
    """

    def run(batches):
        task = TaskContext.get()
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        out, name, done = None, "", []
        count = size = roll = 0
        some = (part for batch in batches for part in rows_by_bytes(batch, "html"))
        for batch in some:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{roll}.warc.gz"
                    out, count, size, roll = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0, roll + 1
                payload = (html or "").encode("utf-8", "surrogatepass")
                record = write_record(page, url, payload, hashlib.sha256(payload).hexdigest(), len(payload), refers)
                out.write(record)
                count, size = count + 1, size + len(record)
                if size >= ROLL:
                    out.close()
                    done, out = [*done, (name, count, size)], None
        if out is not None:
            out.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            ["path", "records", "bytes"],
        )

    return staged(arrow_map(with_references(pages, id_col, url_col, html_col), run, "path string, records long, bytes long"), "manifest", 0)


def read(archives: DataFrame) -> DataFrame:
    """Every record of the archives in the column ``path``, verified."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = _files(path)
                with files.open_input_stream(name, compression=None) as stream:
                    rows = []
                    for record in records(stream):
                        rows.append(record)
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    n = max(1, archives.count())
    return arrow_map(archives.select("path").repartition(min(n, 100_000)), run, READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc")))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
