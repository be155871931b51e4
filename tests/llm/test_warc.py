import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from rotativa.llm import warc

ROWS = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (3, "http://b/", "same"), (1, "http://c/\r\nX: y", ""),
    (2, "http://d/", None), (None, "http://e/", "alone"), (None, "http://f/", "same"), (7, "http://g/", "héé\r\n\r\nWARC/1.1\r\n" * 2000), (8, "u", "z" * 3_000_000),
]


@pytest.fixture(scope="module")
def bundles(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").withColumn("first", F.lit(1)).withColumn("_part", F.lit(2))
    frame = warc.write_bundles(pages).cache()
    yield frame
    frame.unpersist()


def test_round_trip(bundles):
    found = sorted((r for r in warc.read_bundles(bundles).collect()), key=str)
    want = []
    for page_id, _, html in ROWS:
        payload = (html or "").encode()
        ids = [i for i, _, h in ROWS if (h or "").encode() == payload and i is not None]
        first = min(ids, default=None)
        revisit = first is not None and page_id != first
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page_id, len(payload), sha, "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_one_record_through_index_and_seek_table(bundles):
    entry = warc.record_index(bundles).filter("record = 'urn:page:7'").first()
    content = bytes(bundles.filter(F.col("bundle") == entry["bundle"]).first()["content"])
    frame = warc.read_frame(content, entry["frame"])
    headers, block, end = warc.read_record(frame, entry["offset"])
    assert end == entry["offset"] + entry["length"]
    assert headers["WARC-Record-ID"] == "<urn:page:7>"
    assert block.endswith(ROWS[8][2].encode())


def test_bundles_are_plain_zstandard(bundles, tmp_path):
    import zstandard

    paths = [r["path"] for r in warc.export_files(bundles, str(tmp_path / "out")).collect()]
    assert len(paths) == bundles.count()
    for path in paths:
        with open(path, "rb") as f:
            assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.1\r\n")


def test_small_payloads_may_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    found = {r["page_id"]: r["record_type"] for r in warc.read_bundles(warc.write_bundles(pages, min_revisit=3)).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_bundles(warc.write_bundles(pages)).count() == 0
