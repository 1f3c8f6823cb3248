"""Archives: round trip, predicates, skipped payloads."""

import base64
import gzip
import hashlib
import io

import pytest

from recordflow.llm.warc import WarcReader, archive_round_trip, parse_headers, read_warc, write_warc
from tests.oracle_check import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
PAGES = [(5, "http://a/ b\n", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (3, None, "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (9, "http://c", None), (8, "http://d", ""),
         (7, "http://e", "x" * 300000), (None, "http://f", "x" * 300000), (11, "u", "same"), (11, "u", "same")]


def b32(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, id int")


def test_round_trip(pages, tmp_path):
    got = sorted(map(tuple, archive_round_trip(pages, str(tmp_path / "w")).collect()), key=str)
    first = {"<p>é\r\n\r\nWARC/1.1\r\n</p>": 3, None: 8, "": 8, "x" * 300000: 7, "same": 11}
    want = [(i, len((h or "").encode()), b32(h), "response" if i == first[h] else "revisit", None if i == first[h] else first[h]) for i, _, h in PAGES]
    assert got == sorted(want, key=str)


def test_payloads_and_predicates(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    write_warc(pages, path)
    whole = read_warc(spark, path, verify="true").collect()
    assert sorted(r["payload"].decode() for r in whole if r["record_type"] == "response") == sorted(
        ["<p>é\r\n\r\nWARC/1.1\r\n</p>", "", "x" * 300000, "same", "same"])
    assert {r["payload"] for r in whole if r["record_type"] == "revisit"} == {None}
    assert {r["target_uri"] for r in whole} >= {"http://a/%20b%20", "urn:none"}
    assert read_warc(spark, path, types="revisit").count() == 3
    assert [r["record_id"] for r in read_warc(spark, path, **{"header.WARC-Target-URI": "http://e"}).collect()] == ["<urn:page:7>"]


def test_filters_are_pushed_down(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    write_warc(pages, path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = read_warc(spark, path).where("record_type = 'revisit' and payload_bytes > 0")
        assert sorted(r["record_id"] for r in df.collect()) == ["<urn:page:5>", "<urn:page:none>"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_min_bytes(spark, pages, tmp_path):
    write_warc(pages, str(tmp_path / "w"), min_bytes=10)
    kinds = {r["record_id"]: r["record_type"] for r in read_warc(spark, str(tmp_path / "w")).collect()}
    assert kinds["<urn:page:9>"] == "response" and kinds["<urn:page:5>"] == "revisit"


def test_unwanted_blocks_are_skipped_unread(spark, pages, tmp_path):
    write_warc(pages.coalesce(1), str(tmp_path / "w"))
    seen = []

    class Reader(WarcReader):
        @staticmethod
        def _skip(stream, length):
            seen.append(length)
            stream.seek(length, io.SEEK_CUR)

    reader = Reader({"path": str(tmp_path / "w"), "types": "revisit"})
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 3 and sum(n > 200000 for n in seen) == 1


def test_gzip_and_broken_files(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    assert [bytes(r["payload"]) for r in read_warc(spark, str(tmp_path / "a.warc.gz")).collect()] == [b"hi", b"hi"]
    with pytest.raises(ValueError, match="no record begins"):
        parse_headers(io.BytesIO(b"junk\r\n"), "x")
    (tmp_path / "b.warc").write_bytes(record[:-6])
    with pytest.raises(Exception, match="cut off"):
        read_warc(spark, str(tmp_path / "b.warc")).collect()


def test_empty_table(pages, tmp_path):
    assert archive_round_trip(pages.limit(0), str(tmp_path / "w")).count() == 0


def test_query_agrees_with_sql(spark):
    assert compare(spark, oracle_connection(SF_DIR), "op4_warc", SF_DIR) == []
