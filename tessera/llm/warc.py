"""Legacy web archives to WARC: convert, write and read back.

An ARC file begins with a version block that names its header format; each
record is one header line (5 fields in version 1, 10 in version 2), as many
bytes as the line's last field declares, and a line feed.  The converter turns
records into WARC/1.1: a record id derived from the record's content, the date
in ISO form, the type (response, or revisit for a payload that another record
holds) and SHA-256 digests.

Archives are written by Spark's own writer (any Hadoop file system, committed
task by task), a bounded number of bytes to a file, and read back whole file by
file, following the declared lengths.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, scratch_path

MIN_SHARED = 100  # payload bytes from which equal payloads are stored once
FILE_BYTES = 24_000_000
_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    """One record of a legacy archive."""

    url: str
    ip: str
    date: str
    type: str
    body: bytes
    extra: dict[str, str] = field(default_factory=dict)


def arc_header(version: int, name: str, date: str) -> bytes:
    """The version block that an ARC file begins with."""
    body = f"{version} 0 tessera\n{_NAMES[version]}\n".encode()
    return arc_record(1, ArcRecord(f"filedesc://{name}", "0.0.0.0", date, "text/plain", body)) if version == 1 else (
        arc_record(2, ArcRecord(f"filedesc://{name}", "0.0.0.0", date, "text/plain", body))
    )


def arc_record(version: int, r: ArcRecord) -> bytes:
    """One record in the given version; blanks in fields are escaped."""
    clean = lambda v: "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in v.encode()) or "-"
    values = {"url": r.url, "ip": r.ip, "date": r.date, "type": r.type, "length": str(len(r.body)), "result": "200", **r.extra}
    line = " ".join(clean(values.get(f, "-")) for f in _FIELDS[version])
    return line.encode() + b"\n" + r.body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, by the version that its first block declares."""
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        if end == at:  # records may be separated by more line feeds
            at += 1
            continue
        fields = data[at:end].decode("ascii", "replace").rstrip("\r").split(" ")
        size = int(fields[-1])
        body = data[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError(f"the record at byte {at} declares {size} bytes and has {len(body)}")
        at = end + 1 + size + 1
        if version is None:
            version = int(body.split(b" ", 1)[0])
            if version not in _FIELDS:
                raise ValueError(f"unknown version {version}")
            continue
        names = _FIELDS[version]
        if len(fields) != len(names):
            raise ValueError(f"{len(fields)} fields in a header line of version {version}")
        told = dict(zip(names, fields, strict=True))
        extra = {k: v for k, v in told.items() if k in ("result", "checksum", "location", "offset", "filename")}
        yield ArcRecord(told["url"], told["ip"], told["date"], told["type"], body, extra)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """The header block (with its blank line) and the payload of an HTTP message."""
    at = body.find(b"\r\n\r\n")
    return (body[: at + 4], body[at + 4 :]) if body.startswith(b"HTTP/") and at >= 0 else (b"", body)


def iso_date(date: str) -> str:
    """A 14-digit date as WARC writes it; missing digits count as the earliest."""
    d = (date if date.isdigit() else "")[:14]
    d += "19700101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {date} {digest} {key}')}>"


def to_warc(r: ArcRecord, key: str = "", refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """The WARC record of a legacy record, without the blank lines after it.

    ``refers_to`` makes it a revisit: headers and digest stay, the payload goes.
    """
    head, payload = split_http(r.body)
    digest = hashlib.sha256(payload).hexdigest()
    block = r.body if refers_to is None else head
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(r.url, r.date, digest, key),
        "WARC-Date": iso_date(r.date),
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http;msgtype=response" if head else r.type,
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to, "X-Payload-Length": str(len(payload))}
    lines = [f"{k}: {v}" for k, v in (fields | (extra or {})).items()]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; blocks are read by their declared lengths."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:20]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip()] = value.strip()
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield fields, block


def write_archives(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Write a WARC record for each row of ``pages``, by way of legacy records.

    Among rows with equal payloads (html in UTF-8) of at least ``MIN_SHARED``
    bytes, that with the smallest page_id holds the payload and the others refer
    to it.  Null html is empty, a null URL becomes ``-``; rows with a null
    page_id are responses and referred to by none.  Of repeated rows with one
    page_id none refers to another.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size"))
    large = keyed.where((F.col("size") >= MIN_SHARED) & F.col("page_id").isNotNull())
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    # Only rows that refer elsewhere are joined to the pages.
    refers = large.join(first, "digest").where("page_id > first").select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "first").distinct()
    told = pages.join(refers, (F.col("page_id") == F.col("of")) & (F.sha2("html", 256) == F.col("of_digest")), "left").select(
        "page_id", "url", "html", F.col("first").alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = 0, 0
        for batch in batches:
            values, parts = [], []
            for key, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = 2 if (key or 0) % 2 else 1
                payload = html.encode()
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                legacy = arc_header(version, "pages.arc", date) + arc_record(version, ArcRecord(url or "-", "0.0.0.0", date, "text/html", body))
                extra = {} if key is None else {"X-Page-Id": str(key)}
                target = None
                if refers_to is not None:
                    extra["X-Refers-To-Page-Id"] = str(refers_to)
                    target = f"<urn:x-page:{refers_to}>"
                for record in parse_arc(legacy):
                    out = to_warc(record, str(key), target, extra)
                    size += len(out)
                    values.append(out)
                    parts.append(part)
                    if size >= FILE_BYTES:
                        part, size = part + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(parts, pa.int32())], ["value", "part"])

    records = told.mapInArrow(run, "value binary, part int").withColumn("value", F.col("value").cast("string"))
    records.write.partitionBy("part").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, date, record_id, payload_bytes, payload_digest, record_type, refers_to, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                with gzip.open(io.BytesIO(memoryview(data.as_buffer()))) as stream:
                    for fields, block in parse_warc(io.BufferedReader(stream)):
                        _, payload = split_http(block)
                        revisit = fields["WARC-Type"] == "revisit"
                        told = fields["WARC-Payload-Digest"].partition(":")[2]
                        if not revisit and hashlib.sha256(payload).hexdigest() != told:
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not hold")
                        number = lambda name, f=fields: int(f[name]) if name in f else None
                        rows.append(
                            (number("X-Page-Id"), fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Record-ID"],
                             number("X-Payload-Length") if revisit else len(payload), told, fields["WARC-Type"],
                             number("X-Refers-To-Page-Id"), None if revisit else payload)
                        )
                        size += len(payload)
                        if size > 4_000_000:
                            yield _rows(rows, schema)
                            rows, size = [], 0
                yield _rows(rows, schema)

    kind = (
        "page_id long, url string, date string, record_id string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, payload binary"
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, kind)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back.

    An empty table gives no rows; columns other than page_id, url and html are
    not read.  The archives stay until the session's shared folder is cleared,
    as the result reads them when it is used.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    return read_archives(spark, path)


def clear(spark: SparkSession, path: str) -> None:
    """Delete archives that are no longer read."""
    drop_path(spark, path)
