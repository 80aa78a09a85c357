"""Legacy archive converter: ARC files to WARC, and WARC back.

ARC 1 and ARC 2 differ in the fields of a record's header line, which the archive's own
version block states; a record's body is as long as its line declares, so bodies are cut
by length and never by what they contain. From each record the converter makes the WARC
headers that ARC lacks: record id (a name-based UUID of address, time and digest, so the
same record always gets the same id), W3C timestamp, type and SHA-256 digests of block and
payload. Archives are written as gzipped files of bounded size through Spark's writer,
so they lie wherever Spark can write, and are read back by declared lengths. An ARC file's
version block becomes a warcinfo record, an HTTP response a response or a revisit, and what
else it holds (DNS answers, files) a resource.

Cases: a null html is the empty payload; null addresses become `unknown:`; a null page id
is written as no header and read back as null. Of equal payloads of at least `min_bytes`
bytes the rows with the smallest page id (all of them, if rows repeat) are responses; a
null id is larger than any other. Empty tables give an empty folder and no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, ship, slices, table

SEGMENT_BYTES, MIN_BYTES = 8 << 20, 100
ARC1 = "URL IP-address Archive-date Content-type Archive-length"
ARC2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
RECORDS = "record_id string, record_type string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, refers_to long, block_digest_ok boolean"
_CRLF2 = b"\r\n\r\n"


class ArchiveError(ValueError):
    """An archive that does not hold what its headers declare."""


# --- ARC -----------------------------------------------------------------------------


def arc_version_block(version: int, name: str = "segment.arc") -> bytes:
    body = f"{version} 0 blockframe\n{ARC1 if version == 1 else ARC2}\n".encode()
    fields = ["filedesc://" + name, "0.0.0.0", "20240101000000", "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body


def arc_record(version: int, url: str, date: str, body: bytes, mime: str = "text/html", name: str = "segment.arc", offset: int = 0) -> bytes:
    """A record: newline, header line, body. Fields hold no spaces, so those of an address are escaped."""
    url = re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [url, "0.0.0.0", date, mime]
    if version == 2:
        fields += ["200", hashlib.md5(body).hexdigest(), "-", str(offset), name]
    return b"\n" + " ".join([*fields, str(len(body))]).encode() + b"\n" + body


@dataclass
class ArcRecord:
    url: str
    date: str
    mime: str
    body: bytes


def read_arc(stream: io.BufferedIOBase, versions: bool = False) -> Iterator[ArcRecord]:
    """Records of one ARC file (after gunzipping); its version block, which comes first and names the header fields, is one of them if `versions`."""
    fields: list[str] = []
    while True:
        line = stream.readline()
        if not line:
            return
        line = line.rstrip(b"\r\n")
        if not line:
            continue  # the newline before each record
        parts = line.decode("utf-8", "replace").split(" ")
        try:
            length = int(parts[-1])
        except ValueError:
            raise ArchiveError(f"no length in the header line {line[:80]!r}") from None
        body = stream.read(length)
        if len(body) != length:
            raise ArchiveError(f"{len(body)} bytes where {length} are declared")
        if not fields:
            if not parts[0].startswith("filedesc:"):
                raise ArchiveError("no version block")
            lines = body.decode("utf-8", "replace").splitlines()
            version = lines[0].split(" ")[0]
            if version not in ("1", "2"):
                raise ArchiveError(f"version {version}")
            fields = (lines[1] if len(lines) > 1 else ARC1 if version == "1" else ARC2).split(" ")
            if versions:
                yield ArcRecord(parts[0], parts[2] if len(parts) > 2 else "", "text/plain", body)
            continue
        if len(parts) != len(fields):
            raise ArchiveError(f"{len(parts)} fields where {len(fields)} are declared")
        named = dict(zip(fields, parts))
        url = re.sub(r"%([01][0-9A-F]|20|25)", lambda m: chr(int(m[1], 16)), named["URL"])
        yield ArcRecord(url, named["Archive-date"], named["Content-type"], body)


# --- WARC ----------------------------------------------------------------------------


def http_response(payload: bytes, page_id: int | None) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def warc_time(date: str) -> str:
    """Fourteen digits, or the twelve of older archives, as a W3C timestamp."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page_id}')}"


def to_warc(arc: ArcRecord, refers_to: tuple[str, int] | None = None) -> bytes:
    """The equivalent WARC record without its closing blank lines; a revisit keeps the HTTP headers alone."""
    if arc.url.startswith("filedesc:"):
        kind, mime, body = "warcinfo", "application/warc-fields", f"software: blockframe\r\nformat: WARC File Format 1.0\r\nisPartOf: {arc.url.partition('//')[2]}\r\n".encode()
    elif arc.body.startswith(b"HTTP/"):
        kind, mime, body = "revisit" if refers_to else "response", "application/http; msgtype=response", arc.body
    else:
        kind, mime, body = "resource", arc.mime, arc.body
    head, _, payload = body.partition(_CRLF2) if mime.startswith("application/http") else (b"", b"", body)
    page = re.search(rb"(?mi)^x-page-id: *(-?\d+)\r?$", head)
    page_id = int(page[1]) if page else None
    digest = hashlib.sha256(payload).hexdigest()
    block = body if kind != "revisit" else head + _CRLF2
    url = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", arc.url)
    lines = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(arc.url, arc.date, digest, page_id)}>",
        f"WARC-Date: {warc_time(arc.date)}",
        f"WARC-Target-URI: {url}",
        f"Content-Type: {mime}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to[0]}>", f"X-Refers-To-Page: {refers_to[1]}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + _CRLF2 + block


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes


def read_warc(stream: io.BufferedIOBase) -> Iterator[WarcRecord]:
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"no WARC version line: {line[:60]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ArchiveError("the archive ends within headers")
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ArchiveError(f"{len(block)} bytes where {length} are declared")
        yield WarcRecord(headers, block)


class Gunzip(io.RawIOBase):
    """A gzip stream of any number of members, unpacked as it is read."""

    def __init__(self, data: bytes):
        self.data, self.pos, self.left, self.unzip = data, 0, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.left:
            if self.unzip.eof:
                rest = self.unzip.unused_data
                self.pos -= len(rest)
                self.unzip = zlib.decompressobj(31)
            if self.pos >= len(self.data):
                return 0
            chunk = self.data[self.pos : self.pos + 65536]
            self.pos += len(chunk)
            self.left = self.unzip.decompress(chunk)
        n = min(len(out), len(self.left))
        out[:n], self.left = self.left[:n], self.left[n:]
        return n


def opened(data: bytes) -> io.BufferedReader | io.BytesIO:
    return io.BufferedReader(Gunzip(data), 1 << 16) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def parse_warc(record: WarcRecord) -> tuple:
    h = record.headers
    head, _, payload = record.block.partition(_CRLF2) if h["content-type"].startswith("application/http") else (b"", b"", record.block)
    page = re.search(rb"(?mi)^x-page-id: *(-?\d+)\r?$", head)
    size = re.search(rb"(?mi)^content-length: *(\d+)\r?$", head)
    kind = h["warc-type"]
    # a revisit holds no payload: its headers state what the full one is
    length = len(payload) if kind != "revisit" else int(size[1])
    digest = hashlib.sha256(payload).hexdigest() if kind != "revisit" else h["warc-payload-digest"].removeprefix("sha256:")
    ok = h["warc-block-digest"] == "sha256:" + hashlib.sha256(record.block).hexdigest() and h["warc-payload-digest"] == "sha256:" + digest
    refers = h.get("x-refers-to-page")
    return h["warc-record-id"].strip("<>"), kind, h["warc-target-uri"], h["warc-date"], int(page[1]) if page else None, length, digest, h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, int(refers) if refers else None, ok


# --- Spark ---------------------------------------------------------------------------


def page_date(page_id: int | None) -> str:
    """A date of one's own for each page that states none: seconds after the beginning of 2024, within a year."""
    return (datetime(2024, 1, 1) + timedelta(seconds=(page_id or 0) % (365 * 86400))).strftime("%Y%m%d%H%M%S")


def arc_rows(pages: DataFrame, version: int | None = None) -> DataFrame:
    """An ARC archive of one record per page, as bytes, beside the columns that pages has besides html; of version 1 for even ids and 2 for odd ones, if none is given."""
    ship(pages.sparkSession)
    rest = [c for c in pages.columns if c not in ("url", "html")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            ids = b.column("page_id").to_pylist()
            made = []
            for i, u, h in zip(ids, b.column("url").to_pylist(), b.column("html").to_pylist()):
                of = version or 1 + (i or 0) % 2
                made.append(arc_version_block(of) + arc_record(of, u if u is not None else "unknown:", page_date(i), http_response((h or "").encode(), i)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(made, pa.binary())], [*rest, "arc"])

    return pages.mapInArrow(run, ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest), "arc binary"]))


def segments(records: Iterator[bytes], most: int) -> Iterator[pa.RecordBatch]:
    """Segments (column value), each of whole records and at most `most` bytes, or of one record."""
    part, size = [], 0
    for made in records:
        if part and size + len(made) > most:
            yield pa.RecordBatch.from_arrays([pa.array([_CRLF2.join(part)], pa.binary())], ["value"])
            part, size = [], 0
        part.append(made)
        size += len(made)
    if part:
        yield pa.RecordBatch.from_arrays([pa.array([_CRLF2.join(part)], pa.binary())], ["value"])


def convert(arcs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """WARC segments (column value) of rows with an ARC archive of one record each (arc), and the page that it revisits, if any (first: page_id, url)."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for arc, first in zip(b.column("arc"), b.column("first").to_pylist()):
                (record,) = read_arc(io.BytesIO(arc.as_py()))
                refers = None
                if first is not None:
                    digest = hashlib.sha256(record.body.partition(_CRLF2)[2]).hexdigest()
                    refers = record_id(first["url"], page_date(first["page_id"]), digest, first["page_id"]), first["page_id"]
                yield to_warc(record, refers)

    return arcs.mapInArrow(lambda batches: segments(records(batches), segment_bytes), "value binary")


def convert_files(spark: SparkSession, source: str, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the records of ARC files (plain or gzipped) in a folder, version blocks among them, as gzipped WARC files. A file is one task's stream."""
    ship(spark)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for data in b.column("content"):
                yield from map(to_warc, read_arc(opened(data.as_py()), versions=True))

    files = spark.read.format("binaryFile").load(source).select("content")
    write_warc(files.mapInArrow(lambda batches: segments(records(batches), segment_bytes), "value binary"), path)


def write_warc(segments: DataFrame, path: str) -> None:
    """Segments as gzipped WARC files, each of one segment. Their bytes are written as they are."""
    segments.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives in a folder, cut by their declared lengths."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows = [parse_warc(r) for r in read_warc(opened(data.as_py()))]
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=_ARROW)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORDS)


_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]]) for n, x in zip(_NAMES, RECORDS.split(", "))])


def archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, segment_bytes: int = SEGMENT_BYTES, version: int | None = None) -> None:
    """Writes pages as WARC, by way of ARC records; equal payloads are stored once.

    One aggregation, with partial minima before its shuffle, finds the first page of each
    digest that occurs twice; the pages are then joined to that side by digest. Payloads too
    short to be revisited get keys of their own, so that the empty one gathers nowhere; a
    frequent longer one is an equi-join on its digest, which adaptive execution splits."""
    pages = pages.select("page_id", F.coalesce("url", F.lit("unknown:")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("url")))
    keyed = pages.withColumn("digest", F.when(F.octet_length("html") >= min_bytes, F.sha2(F.col("html").cast("binary"), 256)).otherwise(own))
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("url").alias("url"))
    twice = keyed.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1 AND NOT o.none")
    first = twice.select("digest", F.struct(F.col("o.page_id").alias("page_id"), F.col("o.url").alias("url")).alias("first"))
    joined = keyed.join(first, "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first.page_id"))
    marked = joined.withColumn("first", F.when(F.col("first.page_id").isNotNull() & other, F.col("first"))).drop("digest")
    write_warc(convert(arc_rows(marked, version), segment_bytes), path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    archive(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::bigint AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT h.page_id, h.payload_bytes, h.payload_digest,
  CASE WHEN f.first_id IS NULL OR h.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id IS NULL OR h.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM h LEFT JOIN f USING (payload_digest)
"""
