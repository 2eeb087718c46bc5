"""Findings of round 3: what is shuffled, read twice or held for each mark."""

import time
from contextlib import contextmanager

from pyspark.sql import functions as F

from quire.functions.quotes import repaired_quotes
from quire.functions.scalars import EDGE, word_core
from quire.operators import joins, pages, regions, segments, vocabulary


@contextmanager
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("-1", "false")):
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


GEO = "doc_id long, line_no int, page int, grp int, text string, x0 double, x1 double, oy double, size double, weight int, angle double, left double, right double, pitch double, justified boolean, body double, space double"


def test_line_joins_shuffle_lines_once(spark):
    texts = {1: ["aa infor", "mation bb", "x information y well-known z", "so well-", "known as", "x sch", "ool y"], 2: ["aa infor", "mation bb", "x 학교에서 y", "z 학", "교 w"]}
    rows = [(d, i, 0, 0, t, 40.0, 189.0, 14.0 * i, 10.0, 400, 0.0, 40.0, 190.0, 14.0, False, 10.0, 2.5) for d, ts in texts.items() for i, t in enumerate(ts)]
    with no_broadcast(spark):
        got = joins.line_joins(spark.createDataFrame(rows, GEO))
        assert shuffles(got) == 1
        kinds = {(r.doc_id, r.line_no): (r.kind, r.reason) for r in got.collect()}
    assert kinds[1, 1] == ("none", "known in one piece") and kinds[2, 1] == ("space", "evidence")
    assert kinds[1, 4] == ("none", "known with its hyphen") and kinds[2, 4] == ("none", "known in one piece")
    assert len(kinds) == 10


LINE = "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double"


def test_readings_of_a_long_line(spark):
    n = 80_000
    base = spark.createDataFrame([(1, 0, 0, "漢字 word " * (n // 8), 0.0, 20.0, n * 6.0, 40.0)], LINE)
    i = F.col("id")
    above = spark.range(n // 8).select(F.lit(1).cast("long"), F.lit(0), (i + 1).cast("int"), F.lit("かんじ"), i * 48.0, F.lit(8.0), i * 48.0 + 12, F.lit(18.0))
    began = time.time()
    got = regions.readings(base.union(above)).select(F.count("*"), F.sum((F.col("start") == (F.col("line_no") - 1) * 8).cast("int")), F.sum((F.col("stop") - F.col("start") == 2).cast("int"))).first()
    assert tuple(got) == (n // 8, n // 8, n // 8)
    assert time.time() - began < 20


def test_many_marks_in_one_text(spark):
    n = 3000
    text = spark.range(1).select(F.repeat(F.lit("가 \"나 다\" 'x. 라' "), n).alias("t"))
    began = time.time()
    got = text.select(repaired_quotes("t")).first()[0]
    assert got == "가 “나 다” “x. 라” " * n
    assert time.time() - began < 20


def test_words_are_trimmed_without_patterns(spark):
    df = spark.createDataFrame([(t,) for t in ("(a)", "“..a.b”\t", "so\u00adft\u00ad,", "...", "", "x]", "[]{}「」『』《》〈〉.,!?;:…·'‘’\x0b y", None)], "t string")
    old = F.regexp_replace(F.regexp_replace("t", "\u00ad", ""), rf"^{EDGE}++|(?<!{EDGE}){EDGE}++\z", "")
    got = df.select(word_core("t").alias("a"), old.alias("b"))
    assert [r.a for r in got.collect()] == [r.b for r in got.collect()] == ["a", "a.b", "soft", "", "", "x", "y", None]
    assert "regexp" not in df.select(word_core("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_vocabulary_reads_the_text_once(spark):
    df = spark.createDataFrame([(1, 0, "학교 x 학교는 학교를 y"), (1, 1, "y (x) z")], "doc_id long, line_no int, text string")
    once = lambda out: out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    words, families = vocabulary.dictionary(df), vocabulary.line_start_families(df)
    assert once(words) == once(families) == 1
    assert {tuple(r) for r in words.collect()} == {("학교", 1, 0, 2), ("x", 2, 2, 2), ("학교는", 1, 1, 0), ("학교를", 1, 1, 0), ("y", 2, 0, 0), ("z", 1, 0, 0)}
    assert {tuple(r) for r in families.collect()} == {("학교", 3), ("y", 0)}


def test_columns_cost_nothing_by_their_width(spark):
    wide = 1e8
    rows = [(1, 0, i, "abcdefghij", i % 2 * wide * 2, i // 2 * 20.0, i % 2 * wide * 2 + wide, i // 2 * 20.0 + 12) for i in range(6)] + [(1, 0, 6, "over", 0.0, 100.0, wide * 3, 112.0)]
    rows += [(2, 0, i, "", 10.0 + i * 5, i * 20.0, 10.0 + i * 5 + (3 if i == 2 else 0), i * 20.0 + 12) for i in range(5)]  # characters without width
    began = time.time()
    got = {(r.doc_id, r.line_no): (r.col, r.place) for r in pages.column_order(spark.createDataFrame(rows, LINE)).collect()}
    assert [got[1, i] for i in range(7)] == [(0, 1), (1, 4), (0, 2), (1, 5), (0, 3), (1, 6), (None, 7)]
    assert [got[2, i] for i in range(5)] == [(0, 1), (1, 2), (None, 5), (6, 3), (7, 4)]
    assert time.time() - began < 20


def test_turned_lines_meet_in_windows_alone(spark):
    rows = [(1, 0, i, c, x, 0.0, 0.0, 10.0) for i, (c, x) in enumerate([("a", 0.0), ("b", 5.0), ("c", 10.0), ("d", 40.0), (" ", 45.0), ("e", 45.0), ("e", 45.0)])] + [(1, 1, 0, "x", 0.0, 0.0, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, ci int, c string, ox double, oy double, angle double, size double")
    with no_broadcast(spark):
        got = segments.turned_lines(df)
        assert shuffles(got) == 1
        assert {(r.page, r.text) for r in got.collect()} == {(0, "abc dee"), (1, "x")}
