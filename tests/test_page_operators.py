"""Tables, gutters, regions and spacing on small pages written by hand, on nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from quire.operators import gutters, regions, spacing, tables

PATH = "doc_id long, page int, path_id int, x0 double, y0 double, x1 double, y1 double, stroke array<int>, fill array<int>, stroke_width double"
GLYPH = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, oy double, size double"
PAGE = "doc_id long, page int, page_w double, page_h double"
BLACK = [0, 0, 0]


def grid(missing=()):
    """A table of 3 rows and 3 columns, 100 by 30 each, from (50, 50), without the missing rules."""
    rules = {("h", r, c): (50.0 + 100 * c, 50.0 + 30 * r, 150.0 + 100 * c, 51.0 + 30 * r) for r in range(4) for c in range(3)}
    rules |= {("v", r, c): (50.0 + 100 * c, 50.0 + 30 * r, 51.0 + 100 * c, 80.0 + 30 * r) for r in range(3) for c in range(4)}
    return [(1, 0, i, *b, None, BLACK, 0.0) for i, (k, b) in enumerate(sorted(rules.items())) if k not in missing]


def text(*cells):
    return [(1, 0, 70.0 + 100 * c, 60.0 + 30 * r, 75.0 + 100 * c, 68.0 + 30 * r, 68.0 + 30 * r, 8.0) for r, c in cells]


EVERY = [(r, c) for r in range(3) for c in range(3)]


def found(spark, paths, glyphs):
    df = tables.page_tables(spark.createDataFrame(paths, PATH), spark.createDataFrame(glyphs, GLYPH), spark.createDataFrame([(1, 0, 500.0, 700.0)], PAGE))
    return sorted((r.row, r.col, r.colspan, r.rowspan) for r in df.collect())


@pytest.mark.parametrize(
    "missing,want",
    [
        ((), [(r, c, 1, 1) for r, c in EVERY]),
        ([("v", 0, 1)], [(0, 0, 2, 1), (0, 1, 1, 1)] + [(r, c, 1, 1) for r, c in EVERY if r]),
        ([("h", 1, 2)], [(0, 0, 1, 1), (0, 1, 1, 1), (0, 2, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)] + [(2, c, 1, 1) for c in range(3)]),
    ],
)
def test_grid(spark, missing, want):
    assert found(spark, grid(missing), text(*EVERY)) == sorted(want)


def test_no_tables(spark):
    assert found(spark, grid(), text((0, 0), (1, 1))) == []  # too little text
    assert found(spark, [], text(*EVERY)) == [] and found(spark, grid(), []) == []
    frame = [(1, 0, 0, 50.0, 50.0, 350.0, 350.0, BLACK, None, 0.5)]
    assert found(spark, frame, text(*EVERY)) == []  # a frame that is too high for a note
    note = [(1, 0, 0, 50.0, 50.0, 350.0, 140.0, BLACK, None, 0.5), (1, 0, 1, 450.0, 600.0, 451.0, 680.0, None, BLACK, 0.0)]  # pages with fewer than three upright rules have no tables
    assert found(spark, note, text(*EVERY)) == [(0, 0, 1, 1)]


def test_backgrounds(spark):
    paths = [(1, 0, 0, 60.0, 55.0, 90.0, 70.0, None, [255, 255, 0], None), (1, 0, 1, 60.0, 85.0, 300.0, 100.0, BLACK, None, 0.5), (1, 0, 2, 60.0, 55.0, 300.0, 100.0, BLACK, None, 0.5)]
    got = tables.line_backgrounds(spark.createDataFrame(paths, PATH), spark.createDataFrame(text((0, 0), (1, 0), (1, 1)), GLYPH)).collect()
    assert {(r.path_id, r.kind) for r in got} == {(0, "highlight"), (1, "box")}


def columns(spark, rows):
    glyphs = [(1, 0, i, k, a, b, 10.0) for i, row in enumerate(rows) for k, (a, b) in enumerate(row)]
    lines = [(1, 0, i, 100.0 + 14 * i, 10.0) for i in range(len(rows))]
    return spark.createDataFrame(glyphs, "doc_id long, page int, row int, ci int, x0 double, x1 double, size double"), spark.createDataFrame(lines, "doc_id long, page int, row int, oy double, size double"), spark.createDataFrame([(1, 0, 500.0, 700.0)], PAGE)


def test_gutters(spark):
    two = [[(40.0, 240.0), (260.0, 460.0)]] * 8
    got = gutters.find_gutters(*columns(spark, two)).collect()
    assert [(r.low, r.high, r.cut, r.n_split, r.n_cross) for r in got] == [(241.0, 260.0, 250.0, 8, 0)]
    assert gutters.find_gutters(*columns(spark, two[:5])).collect() == []
    assert gutters.find_gutters(*columns(spark, [[(40.0, 460.0)]] * 8)).collect() == []
    glyphs, rows, pages = columns(spark, [*two, [(40.0, 460.0)]])
    cuts = gutters.find_gutters(glyphs, rows, pages)
    assert [r.row for r in gutters.rows_across(glyphs, rows, cuts).collect()] == [8]
    assert gutters.find_gutters(glyphs.limit(0), rows.limit(0), pages).collect() == []


def test_ragged_gaps(spark):
    rows = [[(40.0, 230.0 + 10 * (i % 2)), (248.0 + 10 * (i % 2), 460.0)] for i in range(8)]
    got = gutters.find_gutters(*columns(spark, rows)).collect()
    assert len(got) == 1 and 230 <= got[0].cut <= 263


BOX = "doc_id long, page int, box_id long, x0 double, y0 double, x1 double, y1 double, label string, page_w double"


def test_regions(spark):
    boxes = [(1, 0, 1, 0.0, 0.0, 480.0, 10.0, "text", 500.0), (1, 0, 2, 260.0, 20.0, 460.0, 40.0, None, 500.0), (1, 0, 3, 10.0, 20.0, 200.0, 40.0, "text", 500.0), (1, 0, 4, 10.0, 50.0, 210.0, 70.0, "text", 500.0), (1, 0, 5, 260.0, 50.0, 450.0, 90.0, "image_text", 500.0)]
    df = spark.createDataFrame(boxes, BOX)
    got = regions.ordered_regions(df)
    assert [(r.box_id, r.scope) for r in got.orderBy("place").collect()] == [(1, "wide-0"), (3, "body-b1-c0"), (4, "body-b1-c0"), (2, "body-b1-c1"), (5, "image-b1-c1-r1")]
    assert sorted((r.place, r.n) for r in regions.compacted_regions(got).collect()) == [(0, 1), (1, 2), (3, 1), (4, 1)]
    assert regions.ordered_regions(df.limit(0)).collect() == []


def test_readings(spark):
    lines = [(1, 0, 0, "漢字を読む", 0.0, 20.0, 100.0, 40.0), (1, 0, 1, "かんじ", 0.0, 8.0, 40.0, 18.0), (1, 0, 2, "not kana", 0.0, 8.0, 40.0, 18.0), (1, 0, 3, None, 0.0, 8.0, 40.0, 18.0), (1, 0, 4, "", 0.0, 8.0, 40.0, 18.0)]
    df = spark.createDataFrame(lines, "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    got = regions.readings(df)
    assert [(r.line_no, r.base, r.start, r.stop, r.reading) for r in got.collect()] == [(1, 0, 0, 2, "かんじ")]
    assert [(r.text, r.html) for r in regions.with_readings(df, got).collect()] == [("漢字（かんじ）を読む", "<ruby>漢字<rt>かんじ</rt></ruby>を読む")]
    assert regions.readings(df.limit(0)).collect() == []


def test_pieces(spark):
    images = [(1, 0, i, 10.0, 10.0 + 20 * i, 110.0, 30.0 + 20 * i, 500.0, 500.0) for i in range(4)] + [(1, 0, 9, 300.0, 10.0, 400.0, 30.0, 500.0, 500.0), (1, 0, 10, 300.0, 300.0, 303.0, 303.0, 500.0, 500.0), (2, 0, 1, 10.0, 10.0, 110.0, 30.0, 500.0, 500.0)]
    df = spark.createDataFrame(images, "doc_id long, page int, box_id long, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double")
    none = spark.createDataFrame([], GLYPH)
    assert {(r.doc_id, r.box_id): r.group_id for r in regions.image_pieces(df, none).collect()} == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 9): 9, (2, 1): 1}
    words = spark.createDataFrame([(1, 0, 20.0 + 10 * k, y, 25.0 + 10 * k, y + 4, y + 4, 4.0) for k in range(3) for y in (14.0, 34.0)], GLYPH)
    assert {r.box_id: r.group_id for r in regions.image_pieces(df, words).collect() if r.doc_id == 1} == {0: 0, 1: 1, 2: 1, 3: 1, 9: 9}  # two cards with text of their own


def test_labels(spark):
    boxes = [(1, 0, r * 2 + c, 10.0 + 150 * c, 10.0 + 22 * r, 60.0 + 150 * c, 30.0 + 22 * r) for r in range(2) for c in range(2)] + [(1, 0, 9, 10.0, 300.0, 60.0, 320.0)]
    word = lambda ci, w, x, y: (1, 0, ci, w, x, x + 12, y, y + 8, y + 8, 8.0)
    words = [word(0, "Type", 15.0, 14.0), word(1, "a", 70.0, 14.0), word(2, "b", 90.0, 14.0), word(3, "Size", 165.0, 14.0), word(4, "9", 230.0, 14.0), word(5, "Last", 15.0, 36.0)]
    df = regions.label_tables(spark.createDataFrame(boxes, "doc_id long, page int, box_id long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(words, "doc_id long, page int, ci int, w string, x0 double, x1 double, y0 double, y1 double, oy double, size double"))
    assert sorted((r.row, r.col, r.label, r.value) for r in df.collect()) == [(0, 0, "Type", "a b"), (0, 1, "Size", "9"), (1, 0, "Last", ""), (1, 1, "", "")]


def test_numbers(spark):
    glyphs = [(1, 0, r, k, c, x, x + 5, 10.0) for r in range(5) for k, (c, x) in enumerate([("w", 10.0), *((d, 200.0 - 5 * (len(str(r * 30)) - i)) for i, d in enumerate(str(r * 30)))])]
    df = spark.createDataFrame(glyphs, "doc_id long, page int, row int, ci int, c string, x0 double, x1 double, size double")
    assert sorted((r.row, r.first, r.last) for r in regions.number_columns(df).collect()) == [(r, 1, len(str(r * 30))) for r in range(5)]
    assert regions.number_columns(df.filter("row < 3")).collect() == []


INFO = "doc_id long, line_no int, text string, info array<struct<p:double,g:double,src:string>>"


def test_spacing(spark):
    usual, doubt = (0.0, 0.1, None), (0.5, 0.1, None)
    lines = [(1, 0, "학교에 간다", [usual] * 4), (1, 1, "학교 에 간다", [usual, (0.0, 0.1, "p"), usual, usual]), (1, 2, "끝났다.다음", [usual, usual, usual, usual, usual]), (1, 3, "부 서 명", [(0.0, 0.2, "gap")] * 2), (2, 0, "부 서 명", [(0.0, 0.9, "gap")] * 2), (1, 4, None, None), (1, 5, "plain text", [doubt] * 8), (1, 6, "가나", [usual] * 9)]
    got = {(r.doc_id, r.line_no): (r.text, r.n_changed) for r in spacing.refined_spacing(spark.createDataFrame(lines, INFO)).collect()}
    assert got == {(1, 0): ("학교에 간다", 0), (1, 1): ("학교에 간다", 1), (1, 2): ("끝났다. 다음", 1), (1, 3): ("부서명", 2), (2, 0): ("부 서 명", 0), (1, 4): (None, 0), (1, 5): ("plain text", 0), (1, 6): ("가나", 0)}
    assert spacing.refined_spacing(spark.createDataFrame([], INFO)).collect() == []
