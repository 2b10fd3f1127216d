import base64
import gzip
import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from gneiss.llm import warc


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/x?y=1 2", "<p>one</p>", "c"), (2, None, "<p>one</p>", "c"), (3, "http://b/é\r\n", None, None), (4, "u", "", None), (7, "v", "<p>one</p>", None), (5, "w", "ü" * 300_000, "z"), (6, "w", "line\r\n\r\nline", "z")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")


def test_round_trip(spark, pages):
    index = warc.write(pages)
    got = {r.page_id: r for r in warc.read(index, with_payload=True).collect()}
    for r in pages.collect():
        payload = (r.html or "").encode()
        own = got[r.page_id]
        assert own.url == r.url and own.payload_bytes == len(payload)
        assert own.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert own.record_type == "revisit" or bytes(own.payload) == payload
    assert {k: (v.record_type, v.refers_to) for k, v in got.items()} == {1: ("response", None), 2: ("revisit", 1), 7: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), 6: ("response", None)}


def test_small_payloads_are_all_responses(pages):
    got = warc.read(warc.write(pages, least_bytes=5)).where("page_id = 4").first()
    assert got.record_type == "response"


def test_archives_are_plain_gzip_members(pages, tmp_path):
    index = warc.write(pages, str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(pathlib.Path(tmp_path / "w").iterdir()))
    assert raw.count(b"WARC/1.1\r\n") == index.count() == 7


def test_reads_only_what_is_selected(pages):
    index = warc.write(pages)
    assert [r.page_id for r in warc.read(index.where(F.col("page_id") == 5)).collect()] == [5]


def test_hot_payload_and_empty_table(spark, pages):
    many = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("html"))
    got = warc.read(warc.write(many)).groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in got} == {"response": 4000 - 1333, "revisit": 1333}
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_payloads_that_share_a_page_id(spark):
    rows = [(1, "u", "A", "x"), (5, "u", "A", "x"), (5, "u", "B", "x"), (7, "u", "A", "x"), (7, "u", "Z", "x"), (7, "u", "Z", "x")]
    index = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to string"))
    got = sorted((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read(index, with_payload=True).collect())
    assert got == [(1, "response", None, b"A"), (5, "response", None, b"B"), (5, "revisit", 1, b""), (7, "response", None, b"Z"), (7, "response", None, b"Z"), (7, "revisit", 1, b"")]
