import gzip
import io

import pytest
from pyspark.sql import functions as F

from tidemark.llm.warc import (
    base32_sha1,
    chunked,
    dechunked,
    op5_warc,
    page_records,
    parse_archive,
    read_archives,
    resolved,
    write_archives,
)

SCHEMA = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, "http://a/ 3", None),
    (4, None, ""),
    (5, "http://a/5", "é\r\n\r\n日本" * 4_000),
    (6, "http://a/6", "0\r\n\r\nWARC/1.1\r\n" * 30),
    (7, "http://a/7", "x" * 300_000),
    (8, "http://a/8", "x" * 300_000),
    (9, "http://a/9", "y" * 70_000),
    (9, "http://a/9", "y" * 70_000),
    (None, "http://a/n", "<p>one</p>"),
    (None, "http://a/n", "alone"),
]


def by_hand(rows, least=0):
    last = {}
    for page, _, html in rows:
        if page is not None:
            last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = last.get(html or "")
        again = first is not None and first != page and len(raw) >= least
        out.append((page, len(raw), base32_sha1(raw), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, segment", [(0, 16_384), (11, 1_000), (0, 1 << 30)])
def test_round_trip(spark, tmp_path, least, segment):
    path = f"file://{tmp_path}/w"
    write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path, min_bytes=least, segment_bytes=segment)
    records = read_archives(spark, path).cache()
    assert records.where("problem is not null").count() == 0
    got = resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == by_hand(ROWS, least)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in records.where("record_type = 'response' and page_id is not null").collect()}
    assert payloads[5] == ROWS[4][2].encode() and payloads[8] == ROWS[7][2].encode()


def test_query_and_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("sha1", "bytes", "n", "first_id", "value", "again")])
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = op5_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == by_hand(ROWS)


def test_empty_table(spark, tmp_path):
    write_archives(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")
    (tmp_path / "w" / "part-none.txt.gz").write_bytes(gzip.compress(b""))
    assert read_archives(spark, f"file://{tmp_path}/w").count() == 0


def test_broken_records_are_named(spark, tmp_path):
    end = b"\r\n\r\n"
    long = page_records(1, "http://a", b"a" * 5_000, None, 1_000)
    wrong_total = [r.replace(b"Total-Length: ", b"Total-Length: 9") for r in page_records(2, "http://b", b"b" * 5_000, None, 1_000)]
    bad_chunk = page_records(3, "http://c", b"c" * 100, None, 1 << 20)[0].replace(b"\r\n64\r\n", b"\r\n63\r\n")
    bad_digest = page_records(4, "http://d", b"d" * 100, None, 1 << 20)[0].replace(b"ddd", b"dde")
    good = page_records(5, "http://e", b"e" * 5_000, None, 1_000)
    records = [*long[:2], *long[3:], *reversed(wrong_total), bad_chunk, bad_digest, *reversed(good)]
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(end.join(records[:7]) + end))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(end.join(records[7:]) + end))
    got = {r["page_id"]: r for r in read_archives(spark, f"file://{tmp_path}").collect()}
    assert got[1]["problem"] == "segments are missing" and "bytes, not" in got[2]["problem"]
    assert "chunk" in got[3]["problem"] and "digest" in got[4]["problem"]
    assert all(got[i]["payload"] is None for i in (1, 2, 3, 4))
    assert got[5]["problem"] is None and bytes(got[5]["payload"]) == b"e" * 5_000


def test_framing():
    for payload in (b"", b"a", b"0\r\n\r\n" * 99, "é".encode() * 5_000):
        assert dechunked(chunked(payload, 7)) == payload
    assert dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        list(parse_archive(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))
