"""Rules on odd input: no digits, long numbers, nulls, zero pitches, long runs, broken markup, deep tabs, many like pages."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import documents, flow, lines, pages
from quire.operators.rounds import components
from quire.sources import html_blocks

LINE = "doc_id long, page int, line_no int, text string, oy double, size double, page_h double"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x")).first()[0]


def test_furniture_of_any_text(spark):
    head = lambda p, t, y=10.0, size=10.0: (1, p, p * 10 + int(y) % 10, t, y, size, 1000.0)
    rows = [head(p, "Running head") for p in range(4)] + [head(4, "Chapter one", 12.0), head(5, None), head(6, "xiv"), head(7, "- 7 -", 995.0), head(8, "99999999999 only here"), head(9, "small", 11.0, 5.0)]
    df = spark.createDataFrame(rows, LINE)
    body = spark.createDataFrame([(1, 10.0)], "doc_id long, body double")
    assert sorted(r.page for r in pages.furniture(df, body).collect()) == [0, 1, 2, 3, 6, 7, 9]


def test_one_head_on_many_pages_is_linear(spark):
    n = 3000
    df = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page"), F.lit(0).alias("line_no"), F.lit("Head 1").alias("text"), F.lit(10.0).alias("oy"), F.lit(10.0).alias("size"), F.lit(100.0).alias("page_h"))
    body = spark.createDataFrame([(1, 10.0)], "doc_id long, body double")
    began = time.time()
    assert pages.furniture(df, body).count() == n
    mid = df.withColumn("oy", F.lit(50.0))
    assert lines.duplicate_pages(mid).count() == 0
    paras = df.select("doc_id", "page", F.lit(0).alias("para"), "text", F.lit(0.5).alias("cx"), F.lit(0.1).alias("cy"))
    assert lines.repeated_at_place(paras).count() == n
    bands = df.select("doc_id", "page", F.lit(0).alias("box_id"), F.lit(1.0).alias("y0"), F.lit(5.0).alias("y1"), "page_h")
    assert pages.running_bands(bands).count() == n
    assert time.time() - began < 60


@pytest.mark.parametrize("raw,last,want", [("1-3, 5", 9, [0, 1, 2, 4]), ("3-1", 3, [0, 1, 2]), ("99999999999-1", 9, None), ("1-2000000000", 9, None), ("0", 9, None), ("10", 9, None), ("", 9, None), ("a", 9, None), (" 2 ,, 2", 2, [1])])
def test_page_list(spark, raw, last, want):
    assert one(spark, raw, lambda c: S.page_list(c, F.lit(last))) == want


def test_long_numbers_as_marks(spark):
    assert one(spark, "99999999999.", S.mark_order) is None and one(spark, "12.", S.mark_order) == 12


@pytest.mark.parametrize("text", ["Chapter 1 ..... 12", "Part . . . . iv", "One....", "Two ... 3", "Three .... 12345", "....9", "a. .... 7 "])
def test_toc(spark, text):
    import re

    plain = re.search(r"(?:[.·…‥・_][ ]*){4,}([0-9]{1,4}|[ivxlcIVXLC]{1,6})[ ]*$", text)
    assert one(spark, text, S.is_toc_line) == bool(plain)
    if plain:
        assert tuple(one(spark, text, S.toc_entry)) == (text[: plain.start()].rstrip(), plain[1])


@pytest.mark.parametrize("unit", ["." + " " * 10, ". ", " .", "a."])
def test_toc_is_linear(spark, unit):
    began = time.time()
    one(spark, unit * (500_000 // len(unit)), S.is_toc_line)
    assert time.time() - began < 4


@pytest.mark.parametrize("unit", ["<!--", "<p", "<script>", "<b> </b>", " ", "<", "\n ", "</td>"])
def test_plain_text_is_linear(spark, unit):
    began = time.time()
    one(spark, unit * (400_000 // len(unit)) + "x", html_blocks.plain_text)
    assert time.time() - began < 8


def test_plain_text(spark):
    assert one(spark, "<p>a<!-- x --> b</p><style>s</style><script>never", html_blocks.plain_text) == "a b"


def test_no_pitch(spark):
    df = spark.createDataFrame([(1, 0, 10.0, 0.0), (1, 1, 90.0, 0.0), (1, 2, 200.0, None)], "doc_id long, line_no int, oy double, pitch double")
    assert [r.blanks for r in flow.blank_lines(df).orderBy("line_no").collect()] == [0, 0, 0]
    paras = spark.createDataFrame([(1, 0, 0, 0.0, 1.0, 0.0, None), (1, 0, 0, 50.0, 51.0, 0.0, None)], "doc_id long, page int, col int, y0 double, y1 double, lh double, pitch double")
    assert [r.blanks for r in pages.gaps_between_regions(paras).collect()] == [0, 0]


def test_highlights_whole_unless_asked(spark):
    df = spark.createDataFrame([(1, 1, 0, "red", "t" * 6000, [(1e6, 0.0, 5.0, 5.0)])], "doc_id long, id int, page int, color string, text string, rects array<struct<x:double,y:double,w:double,h:double>>")
    got = documents.clean_highlights(df).first()
    assert len(got.text) == 6000 and got.rects[0].x == 1e6
    got = documents.clean_highlights(df, longest=5, far=10.0).first()
    assert got.text == "ttttt" and got.rects[0].x == 10.0


def test_tabs_of_any_depth(spark):
    para = lambda t: {"paragraph": {"elements": [{"textRun": {"content": t + "\n"}}]}}
    tab = lambda name, *inner: {"tabProperties": {"title": name}, "documentTab": {"body": {"content": [para(f"in {name}")]}}, "childTabs": list(inner)}
    deep = tab("g")
    for name in "fedcb":
        deep = tab(name, deep)
    docs = [(1, json.dumps({"tabs": [tab("a", deep, tab("h")), tab("i")]})), (2, json.dumps({"title": "t", "body": {"content": [para("alone")]}})), (3, "{}"), (4, "no json"), (5, None)]
    got = documents.structured_runs(spark.createDataFrame(docs, "doc_id long, json string")).orderBy("doc_id", "tab").collect()
    assert [(r.doc_id, r.tab, r.tab_name, r.text) for r in got] == [(1, i, c, f"in {c}") for i, c in enumerate("abcdefghi")] + [(2, 0, "t", "alone")]


def test_style_chains_end_at_twenty(spark):
    rows = [(1, k, k - 1 if k else None, True if k in (0, 40) else None, float(k) if k % 7 == 0 else None) for k in range(60)] + [(2, 0, 1, None, None), (2, 1, 0, False, None)]
    got = {(r.doc_id, r.style): (r.bold, r.size) for r in pages.style_chains(spark.createDataFrame(rows, "doc_id long, style int, based_on int, bold boolean, size double")).collect()}
    for k in range(60):
        chain = [j for j in range(k, max(k - 20, -1), -1)]
        assert got[1, k] == (True if {0, 40} & set(chain) else None, next((float(j) for j in chain if j % 7 == 0), None))
    assert got[2, 0] == got[2, 1] == (False, None)


def test_first_occurrences_at_one_place(spark):
    rows = [(1, 5, 1), (1, 3, 1), (1, 4, 2), (1, 5, 3)]
    got = documents.first_occurrences(spark.createDataFrame(rows, "k int, v int, at int"), ["k"], ["v"], ["at"])
    assert {(r.v, r.number) for r in got.collect()} == {(3, 1), (5, 2), (4, 3)}


def test_components_by_key(spark):
    links = [(1, i, i + 1) for i in range(60)] + [(1, 100, 101), (2, 60, 100), (2, 7, 7)]
    got = {(r.k, r.node): r.label for r in components(spark.createDataFrame(links, "k int, a int, b int"), ["k"]).collect()}
    assert got == {**{(1, i): 0 for i in range(61)}, (1, 100): 100, (1, 101): 100, (2, 60): 60, (2, 100): 60}
