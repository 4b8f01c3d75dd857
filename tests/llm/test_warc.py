"""Archives against round trips and records made by hand."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from shardloom.llm import warc

PAGES = "page_id long, url string, html string"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def want(rows):
    """Rows of the query by hand; rows that share page_id and payload are told apart by their place."""
    out, first = [], {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        payload = (rows[i][2] or "").encode()
        page = rows[i][0]
        if payload in first:
            out.append((page, len(payload), digest(payload), "revisit", first[payload]))
        else:
            first[payload] = page
            out.append((page, len(payload), digest(payload), "response", None))
    return sorted(out, key=str)


def pages():
    long = "".join(chr(97 + i % 26) + "é日"[i % 2] for i in range(30_000))
    rows = [(1, "http://a/1", "<p>one</p>"), (9, "http://a/9", "<p>one</p>"), (3, None, None), (2, "http://a/2", ""), (4, "http://a/4\r\nX: y z", "<p>\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n</p>"),
            (5, "u", long), (6, "u", long), (7, "u", long[:-1]), (8, "u", "x" * (16 << 10)), (10, "u", "y" * ((16 << 10) + 1)), (11, "u", "z" * (4 << 10)), (12, "é", "é" * 4097),
            (None, "u", "<p>one</p>"), (None, "u", "alone"), (None, "u", "alone"), (20, "u", "same"), (20, "u", "same"), (21, "u", "\x00\x1f\x8b")]
    return rows + [(i, "hot", "hot page") for i in range(100, 400)]


def shown(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize(("segment", "chunk", "broadcast"), [(16 << 10, 4 << 10, 16 << 20), (700, 64, 0)])
def test_round_trip(spark, tmp_path, monkeypatch, segment, chunk, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast)
    df = spark.createDataFrame(pages(), PAGES).repartition(3)
    path = f"{tmp_path}/a"
    warc.write_archives(df.select("page_id", "url", F.col("html").alias("payload")), path, segment, chunk)
    found = warc.catalogue(spark, path)
    assert found.where("problem is not null").count() == 0 and shown(found) == want(pages())
    back = warc.payloads(warc.reassembled(spark, path)).where("type = 'response'").collect()
    assert {bytes(r.payload) for r in back} == {(x[2] or "").encode() for x in pages()}
    assert {r.uri for r in back if r.page_id == 4} == {"http://a/4%20%20X:%20y%20z"}
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/part-*.gz"))
    assert raw.count(b"WARC-Type: continuation") == warc.records(spark, path, True).where("origin is not null").count() >= 3
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")


def record(kind, name, block, **fields):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + name, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head + [k.replace("_", "-").encode() + b": " + v for k, v in fields.items()]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Any case of field names, a gzip member a record, segments in any order and in other files, extensions and trailers, broken records."""
    http = b"HTTP/1.1 200 OK\r\ntransfer-encoding: gzip, Chunked\r\n\r\n"
    block = http + b"5;x=1\r\nhello\r\nA \r\n, 10 bytes\r\n0\r\nTrailer: 1\r\n\r\n"
    parts = [block[:30], block[30:31], block[31:]]
    whole = len(block)
    files = {
        "a.warc.gz": gzip.compress(record(b"warcinfo", b"<i>", b"software: x")) + gzip.compress(record(b"continuation", b"<s3>", parts[2], WARC_Segment_Number=b"3", WARC_Segment_Origin_ID=b"<s>", WARC_Segment_Total_Length=b"%d" % whole)),
        "b.warc": record(b"response", b"<s>", parts[0], warc_segment_number=b"1", WARC_Payload_Digest=b"sha1:" + digest(b"hello, 10 bytes").encode()) + record(b"response", b"<plain>", b"HTTP/1.0 200 OK\r\n\r\nas it is"),
        "c.warc.gz": gzip.compress(record(b"continuation", b"<s2>", parts[1], WARC_Segment_Number=b"2", WARC_Segment_Origin_ID=b"<s>")),
        "d.warc": record(b"response", b"<short>", b"HTTP/1.1 200 OK\r\n\r\nab", WARC_Segment_Number=b"1") + record(b"continuation", b"<x>", b"c", WARC_Segment_Number=b"2", WARC_Segment_Origin_ID=b"<short>", WARC_Segment_Total_Length=b"99"),
        "e.warc": record(b"continuation", b"<y>", b"c", WARC_Segment_Number=b"2", WARC_Segment_Origin_ID=b"<gone>", WARC_Segment_Total_Length=b"9"),
        "f.warc": record(b"response", b"<frame>", http + b"5\r\nhello") + record(b"response", b"<digest>", b"HTTP/1.1 200 OK\r\n\r\nq", WARC_Payload_Digest=b"sha1:" + digest(b"p").encode()) + record(b"revisit", b"<r>", b"", WARC_Refers_To=b"<none>", WARC_Payload_Digest=b"sha1:" + digest(b"p").encode()),
        "g.warc": record(b"response", b"<cut>", b"HTTP/1.1 200 OK\r\n\r\nabc")[:-9],
        "h.warc": b"", "i.warc": b"no record at all",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.record_id: r for r in warc.payloads(warc.reassembled(spark, str(tmp_path))).collect()}
    assert bytes(got["<s>"].payload) == b"hello, 10 bytes" and got["<s>"].problem is None
    assert bytes(got["<plain>"].payload) == b"as it is"
    assert {k: v.problem for k, v in got.items() if v.problem} == {"<short>": "total length differs", "<gone>": "segments missing", "<frame>": "broken transfer framing", "<digest>": "digest differs", "<cut>": "cut off"}
    assert warc.catalogue(spark, str(tmp_path)).where("problem is not null").count() == 6


def test_base32(spark):
    df = spark.createDataFrame([(hashlib.sha1(str(i).encode()).hexdigest(),) for i in range(40)], "h string")
    assert all(r.b == base64.b32encode(bytes.fromhex(r.h)).decode() for r in df.select("h", warc.base32(F.col("h")).alias("b")).collect())


def test_without_rows(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, payload string"), f"{tmp_path}/a")
    assert warc.catalogue(spark, f"{tmp_path}/a").collect() == []


def test_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert shown(warc.op13_warc(spark, "/root/testdata/sf0.001")) == want(rows)


def test_of_a_table_with_more_columns(spark, tmp_path):
    df = spark.createDataFrame(pages(), PAGES).withColumns({c: F.lit("clash") for c in ("payload", "sha", "row", "first", "record", "block", "digest", "type", "at")})
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert shown(warc.op13_warc(spark, str(tmp_path))) == want(pages())
