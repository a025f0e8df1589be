"""A content-addressed web archive.

Payload bytes are stored once, compressed, under their SHA-256; the exact header bytes of every
record are stored on their own.  A join of the two gives the records back.  Of records with equal
payloads of at least ``least_bytes`` bytes, the one with the largest page_id is the response and
the others revisit it; smaller ones are all responses.

One aggregation by digest finds a payload's response and keeps one copy of its bytes; copies meet
in partial aggregates before anything is shuffled, so a payload that a third of all pages have is
a few rows.  Headers carry digests only.  Reading puts records together again, parses them, and
verifies every payload against its digest and every header against its payload.

Edge cases: null html is the empty payload; a null url is an empty target; CR and LF in a url are
percent-encoded; null page_ids rank below all others; rows that repeat the largest page_id of a
payload are all responses, and its payload is still stored once; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, write_shared

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"


@dataclass
class Archive:
    headers: DataFrame  # page_id, digest, header
    payloads: DataFrame  # digest, response_id, packed


def base32(sha1_hex: Column) -> Column:
    """Base32 of a SHA-1 in hexadecimal: five digits are four of base 32, in another alphabet."""
    groups = [F.lpad(F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _packed(pages: DataFrame) -> DataFrame:
    """page_id, digest and compressed payload of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            bodies = batch.column(1).to_pylist()
            digests = pa.array([sha256(b).digest() for b in bodies], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.array([zlib.compress(b, 4) for b in bodies], pa.binary())], names=["page_id", "digest", "packed"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), utf8("html").alias("payload")).mapInArrow(run, "page_id long, digest binary, packed binary")


def write(pages: DataFrame, least_bytes: int = 0) -> Archive:
    """Store a record for each row (page_id, url, html) of ``pages`` in the shared folder."""
    stored = _packed(pages).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.first("packed").alias("packed"))
    payloads = write_shared(stored, "warc-payloads")
    payload = utf8("html")
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.unhex(F.sha2(payload, 256)).alias("digest"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    both = light.join(payloads.select("digest", "response_id"), "digest")
    revisit = (F.col("n") >= least_bytes) & F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("n"))
    revisited = F.concat(
        line("WARC-Refers-To", _record_id(F.col("response_id"))),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
    )
    header = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, revisited).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n" + HTTP_HEAD),
    )
    return Archive(write_shared(both.select("page_id", "digest", header.cast("binary").alias("header")), "warc-headers"), payloads)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, rest = record.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[n:] != END:
        raise ValueError("not a whole record")
    return fields, rest[:n]


def assemble(header: bytes, payload: bytes) -> bytes:
    """The exact bytes of a record: a revisit holds no payload."""
    return header + (b"" if b"\r\nWARC-Type: revisit\r\n" in header.split(b"\r\n\r\n", 1)[0] else payload) + END


def _joined(archive: Archive) -> DataFrame:
    return archive.headers.join(archive.payloads.select("digest", "packed"), "digest").select("header", "digest", "packed")


def _unpacked(digest: bytes, packed: bytes) -> bytes:
    payload = zlib.decompress(packed)
    if sha256(payload).digest() != digest:
        raise ValueError("a stored payload does not have its digest")
    return payload


def records(archive: Archive) -> DataFrame:
    """header, record (the exact bytes as archived) and payload (in full, for revisits too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed"):
            headers = batch.column(0).to_pylist()
            payloads = [_unpacked(d, p) for d, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            whole = [assemble(h, p) for h, p in zip(headers, payloads)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary()), pa.array(payloads, pa.binary())], names=["header", "record", "payload"])

    return _joined(archive).mapInArrow(run, "header binary, record binary, payload binary")


def _page(identifier: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", identifier or "")
    return int(m[1]) if m else None


def _facts(header: bytes, payload: bytes) -> tuple[int | None, int, str, str, int | None]:
    fields, block = parse(assemble(header, payload))
    digest = base64.b32encode(sha1(payload).digest()).decode()
    body = block.split(b"\r\n\r\n", 1)[1]
    if fields["WARC-Payload-Digest"] != f"sha1:{digest}" or body != (b"" if fields["WARC-Type"] == "revisit" else payload):
        raise ValueError("a record's header does not fit its payload")
    return _page(fields["WARC-Record-ID"]), len(payload), digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))


def read(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, parsed."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed"):
            rows = [_facts(h, _unpacked(d, p)) for h, d, p in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    return _joined(archive).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(hex, {5 * k + 1}, 5))::BIGINT >> {shift}) & 31 AS INTEGER) + 1, 1)"
    for k in range(8)
    for shift in (15, 10, 5, 0)
)
#: The same in DuckDB SQL.
SQL = f"""
WITH own AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response_id FROM pages),
hashed AS (SELECT *, sha1(payload) AS hex, response_id IS NOT NULL AND page_id IS DISTINCT FROM response_id AS revisit FROM own)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN response_id END AS refers_to
FROM hashed
"""
