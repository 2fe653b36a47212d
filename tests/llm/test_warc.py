import base64
import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonewright.llm import warc

from . import fixtures as fx

SCHEMA = "page_id long, url string, html string, digest string, keeper string, revisits string"
ROWS = [
    (1, "http://a.example/x?y=1", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (3, None, None), (4, "http://c.example/ä b", ""), (5, "no address", "é中😀\r\n\r\nWARC/1.1\r\n"),
    (6, "http://a.example/\r\nWARC-Type: evil", "<p>six</p>"), (7, "http://[bad", "<p>one</p>"), (8, "http://d.example", "x" * 300_000), (9, "http://e.example", "y"),
    (9, "http://e.example", "y"), (10, "http://f.example", "z"), (10, "http://g.example", "other"), (None, "http://h.example", "<p>one</p>"), (None, "", "alone"), (11, "", " \n"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "d", None, "r") for r in rows], SCHEMA).repartition(3)


def b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def expected(rows, least=0):
    out = []
    for p, _, t in rows:
        same = [q for q, _, u in rows if (u or "") == (t or "") and q is not None]
        keeper = max(same, default=None)
        back = p != keeper and len((t or "").encode()) >= least and keeper is not None
        out.append((p, len((t or "").encode()), b32(t), "revisit" if back else "response", keeper if back else None))
    return Counter(out)


def test_whole_operator(spark):
    got = warc.capture_digest(pages(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, got.collect())) == expected(ROWS)


def test_least_bytes(spark):
    path = warc.write_archives(pages(spark), least_bytes=5)
    got = warc.assemble(warc.read_records(spark.read.parquet(path)))
    assert Counter((r.metadata.page_id, r.response.kind) for r in got.collect()) == Counter((k[0], k[3]) for k in expected(ROWS, 5).elements())


def test_captures_are_whole(spark):
    path = warc.write_archives(pages(spark))
    captures = warc.assemble(warc.read_records(spark.read.parquet(path), with_payload=True)).collect()
    assert len(captures) == len(ROWS)
    html = {(p, (t or "").encode()) for p, _, t in ROWS}
    ids = {}
    for c in captures:
        assert c.request is not None and c.metadata is not None
        ids[c.response.record_id] = c
        if c.response.kind == "response":
            assert (c.metadata.page_id, bytes(c.response.payload)) in html
    for c in captures:
        if c.response.kind == "revisit":
            assert ids[c.response.refers_to].metadata.page_id == c.metadata.refers_to_page


def test_files_are_plain_warc(spark):
    path = warc.write_archives(pages(spark))
    for r in spark.read.parquet(path).collect():
        data = gzip.decompress(bytes(r.archive))
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        assert b"\r\nWARC-Type: evil" not in data
        heads = [h for h, _ in warc.parse(bytes(r.archive))]
        assert len(heads) % 3 == 0
        assert all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(h) for h in heads)


def test_broken_files_are_told():
    whole = warc.record("response", "<urn:x>", b"abc", "text/plain", "")
    assert [b for _, b in warc.parse(whole + whole)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-12]))
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n")))


def test_records_without_partners(spark):
    data = warc.record("response", "<urn:a>", b"HTTP/1.1 200 OK\r\n\r\nhi", "application/http", "", WARC_Payload_Digest="sha1:" + b32("hi"))
    data += warc.record("request", "<urn:b>", b"GET / HTTP/1.1\r\n\r\n", "application/http", "", WARC_Concurrent_To="<urn:gone>")
    got = warc.assemble(warc.read_records(spark.createDataFrame([("f", bytearray(data))], "file string, archive binary"))).collect()
    assert sorted((r.capture, r.request is None, r.response is None, r.metadata is None) for r in got) == [("<urn:a>", True, False, True), ("<urn:gone>", False, True, True)]


def test_records_over_files_and_steps(spark):
    """Every concurrent-to field counts, in either direction, over files and over other records."""
    r = lambda kind, own, block=b"GET / HTTP/1.1\r\n\r\n", **more: warc.record(kind, own, block, "application/http", "", **more)
    http, digest = b"HTTP/1.1 200 OK\r\n\r\nhi", "sha1:" + b32("hi")
    two = warc.record("metadata", "<m1>", b"page-id: 1\r\n", "application/warc-fields", "", WARC_Concurrent_To="<q1>\r\nWARC-Concurrent-To: <r1>")
    files = [
        r("response", "<r1>", http, WARC_Payload_Digest=digest, WARC_Concurrent_To="<q1>") + r("request", "<q2>", WARC_Concurrent_To="<r2>"),
        r("request", "<q1>") + warc.record("metadata", "<m2>", b"page-id: 2\r\n", "application/warc-fields", "", WARC_Concurrent_To="<q2>"),
        two + r("response", "<r2>", http, WARC_Payload_Digest=digest),
    ]
    assert [h["warc-concurrent-to"] for h, _ in warc.parse(two)] == ["<q1> <r1>"]
    archives = spark.createDataFrame([(f"f{k}", bytearray(d)) for k, d in enumerate(files)], "file string, archive binary")
    for with_payload in (False, True):
        got = warc.assemble(warc.read_records(archives, with_payload)).collect()
        assert sorted((c.capture, c.request.record_id, c.response.record_id, c.metadata.page_id) for c in got) == [("<r1>", "<q1>", "<r1>", 1), ("<r2>", "<q2>", "<r2>", 2)]


def test_empty_table(spark):
    assert warc.capture_digest(pages(spark, [])).collect() == []


def test_hot_payload(spark):
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("html"))
    got = warc.capture_digest(many).groupBy("record_type", "refers_to").count().collect()
    assert {(r.record_type, r.refers_to): r["count"] for r in got} == {("response", None): 2001, ("revisit", 2997): 999}
    assert fx.found(warc.capture_digest(many.limit(0))) == []
