import base64
import hashlib

import pytest
from sigla.llm import warc
from sigla.llm.queries import op5_warc

SF = "/root/testdata/sf0.001"


def plain(rows, least=0):
    rank = lambda i: (i is not None, i or 0)
    largest = {}
    for i, html in rows:
        largest[html or ""] = max(largest.get(html or "", None), i, key=rank)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and largest[html or ""] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", largest[html or ""] if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_equals_plain(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert rows_of(op5_warc(spark, SF)) == plain(rows)


def test_nulls_copies_and_exact_records(spark):
    rows = [(1, "u", "same"), (5, None, "same"), (3, "a\r\nb", "same"), (2, "u", None), (7, "u", ""), (None, "u", "same"), (None, "u", "alone"), (9, "é", "ü" * 70_000), (5, None, "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    for least in (0, 5):
        archive = warc.write(df, least)
        assert rows_of(warc.read(archive)) == plain([(i, h) for i, _, h in rows], least)
    assert archive.payloads.count() == 4
    for r in warc.records(archive).collect():
        fields, block = warc.parse(bytes(r.record))
        assert bytes(r.record).startswith(bytes(r.header))
        body = block[len(warc.HTTP_HEAD) :]
        assert body == (b"" if fields["WARC-Type"] == "revisit" else bytes(r.payload))
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_damage_is_noticed(spark):
    archive = warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"))
    other = warc.write(spark.createDataFrame([(1, "u", "y")], "page_id long, url string, html string"))
    swapped = archive.payloads.select("digest").crossJoin(other.payloads.select("packed"))
    with pytest.raises(Exception, match="digest"):
        warc.read(warc.Archive(archive.headers, swapped)).collect()
