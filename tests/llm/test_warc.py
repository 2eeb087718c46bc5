"""Archives give back the pages, from ranges of the index."""

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from quire.llm.common import filesystem, new_folder
from quire.llm.warc import parse, ranges, read_records, record, round_trip, write_archives

PAGES = [(4, "http://a/4", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, None), (3, "http://a/3", ""), (5, "http://a/\r\n5", "é" * 5000), (None, "http://n", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (7, "x", "only")]


def frame(spark):
    return spark.createDataFrame([(*p, 1, "z") for p in PAGES], "page_id long, url string, html string, offset int, path string")


def test_ranges():
    assert ranges([(0, 10), (10, 5), (100, 5), (106, 4)], gap=1, most=1000) == [(0, 2, 0, 15), (2, 4, 100, 10)]
    assert ranges([(0, 10), (10, 10)], gap=5, most=15) == [(0, 1, 0, 10), (1, 2, 10, 10)]
    assert ranges([], 1, 1) == []


def test_record():
    raw = record(5, "http://x", b"a\r\n\r\nb", None)
    assert parse(raw)[:3] == (5, "http://x", 6) and parse(raw)[6] == b"a\r\n\r\nb"
    assert parse(record(5, "http://x", b"abc", 2))[2:] == (3, base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), "revisit", 2, b"")


def test_round_trip(spark):
    rows = {(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in round_trip(frame(spark)).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert rows == {
        (2, "http://a/2", "response", None, 11, sha("<p>same</p>")), (4, "http://a/4", "revisit", 2, 11, sha("<p>same</p>")), (None, "http://n", "revisit", 2, 11, sha("<p>same</p>")),
        (3, "http://a/3", "response", None, 0, sha("")), (9, "", "revisit", 3, 0, sha("")), (5, "http://a/5", "response", None, 10_000, sha("é" * 5000)), (7, "x", "response", None, 4, sha("only")),
    }
    assert round_trip(frame(spark)).count() == len(PAGES)
    assert {r.record_type for r in round_trip(frame(spark), least=100).collect()} == {"response"}
    assert round_trip(frame(spark).limit(0)).collect() == []


def test_index(spark):
    folder = new_folder(spark, "warc-test")
    index = write_archives(frame(spark), folder, file_bytes=400)
    assert index.select("path").distinct().count() > 1
    for r in index.collect():
        system, path = filesystem(r.path)
        with system.open_input_file(path) as f:
            assert parse(gzip.decompress(f.read_at(r.length, r.offset)))[0] == r.page_id
    some = read_records(index.filter("page_id = 5")).collect()
    assert len(some) == 1 and bytes(some[0].payload).decode() == "é" * 5000


def test_attempts_do_not_share_files(spark):
    """A second attempt that meets the rows in another order leaves the files alone that an index describes."""
    folder = new_folder(spark, "warc-test")
    one = write_archives(frame(spark).coalesce(1).orderBy("page_id"), folder)
    want = sorted(map(str, read_records(one).collect()))
    two = write_archives(frame(spark).coalesce(1).orderBy(F.desc("page_id")), folder)
    assert sorted(map(str, read_records(one).collect())) == want == sorted(map(str, read_records(two).collect()))
    assert not {r.path for r in one.collect()} & {r.path for r in two.collect()}


def test_long_payload(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>" * 300_000), (2, "v", "x")], "page_id long, url string, html string")
    got = {r.page_id: r.payload_bytes for r in round_trip(df).collect()}
    assert got == {1: 9 * 300_000, 2: 1}
