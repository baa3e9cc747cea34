"""WARC archives: a gzip member per record, written as files of bounded size and read back sequentially.

``archived`` turns pages into records. Of pages with equal payloads the one of largest page_id becomes a response, the
others become revisits, which name it and its digest and carry the HTTP head alone. Records are packed into archives of
at most ``ARCHIVE`` compressed bytes (a larger record has one of its own), which a last record closes with their number.
Archives are binary files that Spark's text sink commits, so that a lost executor leaves no half file: each archive is
one row, and its last byte, which is 0 as the closing record is small, is the sink's line separator.

``Reader`` takes a stream: it inflates one member after the other in parts of bounded size, frames the block by its
content length, splits the HTTP head off, and verifies block and payload digests on the way. A record whose digest is
wrong is reported and passed over; where framing breaks, the rest of that archive is one faulty record.

Cases: null html is an empty payload; a null url has no target; a null page_id is smaller than all others; repeated rows
of the largest page_id are responses, all of them; html of any length is one record; other columns never enter; an
empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.shared import keep_path, shared_dir, small_batches, written

#: Compressed bytes of an archive, unless a single record has more.
ARCHIVE = 32 << 20
#: Bytes that the reader takes, inflates or looks through at once, and the most that a head may have.
PART, HEAD = 1 << 16, 1 << 20
#: Bytes of payloads that one batch of records holds.
HELD = 8 << 20
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
END = b"\r\n\r\n"
COUNT = "record-count"

RECORDS = (
    "archive string, position long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary, fault string"
)


def digest(data: bytes) -> str:
    """The SHA-1 in base32, as archives name it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(kind: str, record_id: str, content_type: str, block: bytes, more: dict[str, str | None] | None = None) -> bytes:
    """A record as one gzip member; fields without a value are left out."""
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, "Content-Type": content_type,
        "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block)),
    } | (more or {})
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    squeeze = zlib.compressobj(wbits=31)
    return b"".join(map(squeeze.compress, (VERSION, b"\r\n", head.encode(), b"\r\n", block, END))) + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool) -> bytes:
    """A page as a response, or as a revisit of page ``original``."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    more = {
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": f"<{_name(original)}>" if revisit else None,
    }
    return member("revisit" if revisit else "response", _name(page_id), "application/http;msgtype=response", head if revisit else head + payload, more)


def _name(page_id: int | None) -> str:
    return f"{URN}{'null' if page_id is None else page_id}"


def _archives(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, total = [], 0

    def out() -> pa.RecordBatch:
        close = member("metadata", f"urn:uuid:{uuid.uuid4()}", "application/warc-fields", f"{COUNT}: {len(held)}\r\n".encode())
        return pa.RecordBatch.from_arrays([pa.array([b"".join([*held, close])[:-1]], pa.binary())], ["archive"])

    for batch in batches:
        for page_id, url, html, original, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "original", "revisit")), strict=True):
            data = page_record(page_id.as_py(), url.as_py(), html.as_py(), original.as_py(), revisit.as_py())
            if held and total + len(data) > most:
                yield out()
                held, total = [], 0
            held.append(data)
            total += len(data)
    if held:
        yield out()


def resolved(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (bytes), original (the page of largest id with the same payload, of at least ``least`` bytes)
    and whether the page revisits it."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"),
    )
    rows = rows.withColumn("digest", F.sha1("html"))
    # Written, so that both sides of the join are plain shuffles, of which Spark can split a hot digest's rows.
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").select("digest", "original"), "warc-repeated")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "html", "original", revisit.alias("revisit"))


def archived(pages: DataFrame, least: int = 0, most: int = ARCHIVE) -> str:
    """Writes the archives of all pages to a folder of their own below the shared one; the folder."""
    spark = pages.sparkSession
    small_batches(spark)
    path = keep_path(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    found = resolved(pages, least).mapInArrow(partial(_archives, most=most), "archive binary")
    rows = found.select(F.col("archive").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


@dataclass
class Record:
    position: int
    fields: dict[str, str]
    payload: bytes
    payload_bytes: int
    fault: str | None = None

    def link(self, field: str) -> str | None:
        """A field that names a record or a place, without its brackets."""
        value = self.fields.get(field)
        return value if value is None else value.strip("<>")


class Broken(ValueError):
    """Bytes that are no record, after which the next one can't be found."""


class Reader:
    """The records of a stream of gzip members, in order."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.rest, self.at, self.seen = source, b"", 0, 0

    def __iter__(self) -> Iterator[Record]:
        while self.rest or self._more():
            record = self._record()
            stated = self._stated(record)
            if stated is not None and stated != self.seen:
                record.fault = f"{self.seen} records where {stated} were written"
            self.seen += 1
            yield record

    def _more(self) -> bool:
        self.rest = self.source.read(PART)
        return bool(self.rest)

    @staticmethod
    def _stated(record: Record) -> int | None:
        if record.fields.get("warc-type") != "metadata":
            return None
        found = re.match(rb"%b: (\d+)\r\n" % COUNT.encode(), record.payload)
        return int(found[1]) if found else None

    def _inflated(self) -> Iterator[bytes]:
        """The next member in parts of bounded size."""
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not self.rest and not self._more():
                raise Broken("a member that breaks off")
            before = len(self.rest)
            try:
                part = inflate.decompress(self.rest, PART)
            except zlib.error as e:
                raise Broken(f"no gzip member: {e}") from e
            self.rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            self.at += before - len(self.rest)
            if part:
                yield part

    def _record(self) -> Record:
        position, parts = self.at, self._inflated()
        head, first = _head(parts)
        lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise Broken("a member without a version line")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not fields.get("content-length", "").isdigit():
            raise Broken("a record without a length")
        block = _Block(first, parts, int(fields["content-length"]), Digest(fields.get("warc-block-digest")))
        revisit, payload_bytes = fields.get("warc-type") == "revisit", None
        start = b""
        if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
            http, start = _head(block)
            length = re.search(r"(?im)^content-length:[ \t]*(\d+)", http.decode("latin-1"))
            payload_bytes = int(length[1]) if length and revisit else None
        sums, kept, total = Digest(fields.get("warc-payload-digest")), [], 0
        for part in _chain(start, block):
            sums.update(part)
            kept.append(part)
            total += len(part)
        block.finish()
        fault = block.sums.fault("block")
        if fault is None and not revisit:
            fault = sums.fault("payload")
        return Record(position, fields, b"".join(kept), total if payload_bytes is None else payload_bytes, fault)


def _chain(start: bytes, parts: Iterator[bytes]) -> Iterator[bytes]:
    if start:
        yield start
    yield from parts


def _head(parts: Iterator[bytes]) -> tuple[bytes, bytes]:
    """What stands before the first blank line, and what of the stream was taken after it."""
    found = b""
    for part in parts:
        found += part
        head, mark, rest = found.partition(END)
        if mark:
            return head, rest
        if len(found) > HEAD:
            break
    raise Broken("a head without an end")


class Digest:
    """A running sum, to be held against a field ``name:value`` with the algorithm that it names."""

    def __init__(self, stated: str | None) -> None:
        name, _, self.stated = (stated or "").strip().partition(":")
        self.sum = hashlib.new(name.lower()) if name.lower() in ("md5", "sha1", "sha256", "sha512") else None

    def update(self, part: bytes) -> None:
        if self.sum:
            self.sum.update(part)

    def fault(self, what: str) -> str | None:
        """What is wrong with the stated digest, in base32 or hexadecimal; None if right, absent or of another kind."""
        if not self.sum:
            return None
        right = {base64.b32encode(self.sum.digest()).decode().rstrip("="), self.sum.hexdigest().upper()}
        return None if self.stated.strip().rstrip("=").upper() in right else f"{what} digest {self.stated}"


class _Block:
    """The bytes of a record's block as parts, framed by its length, summed as they pass."""

    def __init__(self, first: bytes, parts: Iterator[bytes], length: int, sums: Digest) -> None:
        self.parts, self.held, self.left, self.sums = parts, first, length, sums

    def __iter__(self) -> Iterator[bytes]:
        return self

    def __next__(self) -> bytes:
        if not self.left:
            raise StopIteration
        if not self.held:
            self.held = next(self.parts, b"")
            if not self.held:
                raise Broken("a block that is shorter than its length")
        part, self.held = self.held[: self.left], self.held[self.left :]
        self.left -= len(part)
        self.sums.update(part)
        return part

    def finish(self) -> None:
        """After the block there are two line ends, and nothing else in the member."""
        tail = self.held
        for part in self.parts:
            tail += part
            if len(tail) > len(END):
                break
        if tail != END:
            raise Broken("a block that is longer than its length")


def _read(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]
    held, total = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            reader = Reader(io.BytesIO(content.as_py()))
            records = iter(reader)
            while True:
                try:
                    record = next(records, None)
                except Broken as e:
                    record = Record(reader.at, {}, b"", 0, str(e))
                    records = iter(())
                if record is None:
                    break
                if strict and record.fault:
                    raise ValueError(f"{path.as_py()} at {record.position}: {record.fault}")
                stated = record.fields.get("warc-payload-digest", "").partition(":")[2] or None
                held.append((
                    path.as_py(), record.position, record.fields.get("warc-type"), record.link("warc-record-id"), record.link("warc-target-uri"),
                    record.link("warc-refers-to"), record.payload_bytes, stated, record.payload, record.fault,
                ))
                total += len(record.payload)
                if total > HELD or len(held) >= 1024:
                    yield out()
                    held, total = [], 0
    if held:
        yield out()


def records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All records of the archives in a folder, with payloads. A faulty one raises, or if not ``strict`` is a row that has
    its ``fault`` (and no type where its bytes are no record at all)."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(partial(_read, strict=strict), RECORDS)


def page_rows(found: DataFrame) -> DataFrame:
    """Page ids, kinds, sizes and digests of the records that hold pages."""
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(URN) + 1}) AS long)")
    pages = found.where(F.col("record_type").isin("response", "revisit"))
    return pages.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def unresolved(found: DataFrame) -> DataFrame:
    """The revisits whose response is in no archive, or has another digest."""
    response = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest").distinct()
    return found.where("record_type = 'revisit'").join(response, ["refers_to", "payload_digest"], "left_anti")
