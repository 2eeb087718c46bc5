"""What large tables need: few shuffles, no work that grows with the square, bounded rows."""

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import boxes, geometry, lines, pages, regions, spacing, tables
from quire.plans import join_queries, table_queries


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def line(spark, text):
    return spark.createDataFrame([(1, 0, text)], "doc_id long, line_no int, text string")


def test_leaders_need_no_shuffle(spark):
    rows = line(spark, "ab???9??x?7")
    sign = lambda c, i: F.struct(i.alias("ci"), c.alias("c"), (i * 5.0).alias("x0"), (i * 5.0 + 4).alias("x1"), F.lit(10.0).alias("size"), F.lit("f").alias("font"))
    found = pages.leader_runs(rows.select("doc_id", "line_no", F.transform(F.split("text", ""), sign).alias("glyphs")), "?")
    assert shuffles(found) == 0
    assert sorted(r.ci for r in found.collect()) == [2, 3, 4]
    as_rows = line(spark, "a??12").select("doc_id", "line_no", F.posexplode(F.transform(F.split("text", ""), sign)).alias("k", "g")).select("doc_id", "line_no", "g.*")
    assert sorted(r.ci for r in pages.leader_runs(as_rows, "?").collect()) == [1, 2]


def test_lines_of_glyphs_need_no_shuffle(spark):
    glyphs = lines.line_glyphs(line(spark, "ab  c d"))
    assert shuffles(lines.joined_glyphs(glyphs)) == 0
    assert [r.text for r in lines.joined_glyphs(glyphs).collect()] == ["ab  c d"]


def test_gaps_of_lines_need_no_shuffle(spark):
    gaps = geometry.line_gaps(lines.line_glyphs(line(spark, "ab  c d")))
    assert shuffles(gaps) == 0
    assert [tuple(r)[2:] for r in gaps.collect()] == [(4, 2, 42.0, 12.0)]
    assert [tuple(r) for r in geometry.line_gaps(lines.glyphs(line(spark, "ab  c d"))).collect()] == [tuple(r) for r in gaps.collect()]


def test_pages_come_by_the_batch(spark):
    df = spark.range(3000).selectExpr("1L AS doc_id", "CAST(id DIV 3 AS INT) AS page", "id AS box_id", "id % 3 * 10.0D AS x0", "0.0D AS y0", "id % 3 * 10.0D + 9 AS x1", "5.0D AS y1", "0.5D AS score")
    for found, n in ((boxes.grown_boxes(df, 2.0), 1000), (boxes.suppressed(df), 3000), (boxes.touching_groups(df), 3000)):
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == n
    many = [(float(i % 40 * 10), float(i // 40 * 10), float(i % 40 * 10 + 9), float(i // 40 * 10 + 9)) for i in range(400)]
    assert boxes.touching(many, 2.0) == [0] * 400
    assert boxes.touching(many, 0.5) == list(range(400))


def test_a_line_number_reads_one_base(spark):
    rows = [(1, 0, 1000, "漢字漢字", 0.0, 10.0, 40.0, 22.0), (1, 0, 2000, "漢字漢字", 0.0, 60.0, 40.0, 72.0), (1, 0, 7, "かな", 0.0, 4.0, 20.0, 9.0), (1, 0, 7, "きし", 0.0, 53.0, 20.0, 58.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.line_no, r.base, r.reading) for r in regions.readings(df).collect()] == [(7, 1000, "かな")]


def test_glyphs_at_one_place_are_one_row(spark):
    glyphs = spark.range(3000).selectExpr("1L AS doc_id", "0 AS page", "id % 3 * 20.0D + 44 AS x0", "5.0D AS y0", "id % 3 * 20.0D + 50 AS x1", "13.0D AS y1", "13.0D AS oy", "IF(id < 2000, 8.0D, 9.0D) AS size")
    centres = tables.centres(glyphs)
    assert centres.count() == 6 and centres.selectExpr("sum(k)").first()[0] == 3000
    paths = spark.createDataFrame([(1, 0, 7, 43.0, 4.0, 103.0, 16.0, [0, 0, 9], None, 0.5)], "doc_id long, page int, path_id int, x0 double, y0 double, x1 double, y1 double, stroke array<int>, fill array<int>, stroke_width double")
    for of in (glyphs, centres):
        assert [tuple(r) for r in tables.line_backgrounds(paths, of).collect()] == [(1, 0, 7, "box")]


def test_gaps_meet_within_stretches(spark):
    """Twenty thousand gaps of one line, 4,000 of them open, between spaces that stay."""
    text = " ".join(["가나다라마"] * 4000)
    info = "transform(sequence(0, 19998), k -> struct(IF(k % 5 = 2, 0.05D, 0.0D) AS p, IF(k % 5 = 4, 0.6D, 0.1D) AS g, IF(k % 5 = 4, 'model', null) AS src)) AS info"
    began = time.time()
    got = spacing.refined_spacing(line(spark, text).selectExpr("*", info)).first()
    assert (got.text, got.n_changed) == (text, 0) and time.time() - began < 40


def test_words_of_a_document_stay_together(spark):
    glyphs, _, _ = table_queries._columned(spark, "/root/testdata/sf0.001")
    after = F.lead("x0").over(Window.partitionBy("doc_id", "page", "row").orderBy("ci"))
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").rdd.getNumPartitions()
    assert shuffles(glyphs.withColumn("after", after)) == 1 + (documents < spark.sparkContext.defaultParallelism)


def test_pieces_meet_once(spark):
    images = [(1, 0, i, 200.0 * (i % 2), 10.0 + 150 * (i // 2), 200.0 + 200 * (i % 2), 160.0 + 150 * (i // 2), 500.0, 500.0) for i in range(6)]
    df = spark.createDataFrame(images, "doc_id long, page int, box_id long, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double")
    # three words with one centre are three, on two pieces that stay apart
    words = spark.createDataFrame([(1, 0, x, 20.0, x + 9, 30.0) for x in (20.0, 220.0) for _ in range(3)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    found = regions.image_pieces(df.filter("box_id < 2"), words)
    assert {r.box_id: (r.group_id, r.overlay) for r in found.collect()} == {0: (0, False), 1: (1, False)}
    assert {r.box_id: r.group_id for r in regions.image_pieces(df, words.limit(3)).collect()} == dict.fromkeys(range(6), 0)
    # words are read for the links alone, not again for what is returned
    assert "cx" not in found._jdf.queryExecution().executedPlan().toString()


def test_trimmed_as_by_its_pattern(spark):
    signs = [*range(0x100), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0x3001, 0xFEFF]
    texts = [(t,) for c in map(chr, signs) for t in (f"{c} a{c}b {c}", c, f"{c}{c}a")] + [("",), (None,), (" \t\u3000",)]
    rows = spark.createDataFrame(texts, "text string").withColumn("old", F.regexp_replace("text", rf"^{S.SPACE}++|(?<!{S.SPACE}){S.SPACE}++\z", ""))
    assert rows.filter(~F.col("old").eqNullSafe(S.trimmed("text"))).count() == 0
    assert "regexp" not in rows.select(S.trimmed("text"))._jdf.queryExecution().analyzed().toString().split("\n")[0]


def test_lines_at_edges_are_looked_at_once(spark):
    rows = spark.createDataFrame([(1, p, p * 2 + k, t, 10.0 + 300 * k, 10.0, 480.0, 320.0) for p in range(3) for k, t in enumerate((f"A head of {p + 4}", f"{p} words at the foot {p * p}"))], "doc_id long, page int, line_no int, text string, oy double, size double, page_w double, page_h double")
    found = pages.furniture(rows, rows.select("doc_id").distinct().withColumn("body", F.lit(10.0)))
    assert sorted(r.line_no for r in found.collect()) == [0, 1, 2, 3, 4, 5]
    assert "regexp_extract" not in found._jdf.queryExecution().executedPlan().toString()


def test_lines_are_split_once_into_fours(spark):
    rows = spark.createDataFrame([("a b c d e",), ("a",), ("",), (" ".join(map(str, range(9))),), (None,)], "text string")
    assert [r[0] for r in rows.select(join_queries._fours(F.col("text"))).collect()] == [["a b c d", "e"], ["a"], [""], ["0 1 2 3", "4 5 6 7", "8"], None]
    # a line's pieces are many: each of them split its whole line again
    assert rows.select(join_queries._fours(F.col("text")).alias("x"))._jdf.queryExecution().analyzed().toString().split("\n")[0].count("split(") == 1
    marks = ["a .... 7", "a . . . . 7", "a ...7", "a. b. c. d. 7", "·  ·  ·  ·  xi  ", "1.5", None]
    assert [r[0] for r in spark.createDataFrame([(m,) for m in marks], "text string").select(S.is_toc_line("text")).collect()] == [True, True, False, False, True, False, None]


def test_areas_of_images_come_by_the_batch(spark):
    images = [(1, p, i, 10.0 + 60 * i, 10.0, 70.0 + 60 * i, 60.0, 120, 100) for p in range(3) for i in range(2)] + [(2, 0, 0, 0.0, 0.0, 400.0, 300.0, 800, 600)]
    df = spark.createDataFrame(images, "doc_id long, page int, box_id long, x0 double, y0 double, x1 double, y1 double, px_w int, px_h int")
    held = spark.createDataFrame([(d, p, 10 if d == 2 else 90, 480.0, 320.0) for d, p in ((1, 0), (1, 1), (1, 2), (2, 0))], "doc_id long, page int, n_chars long, page_w double, page_h double")
    found = pages.image_text_areas(df, held)
    assert sorted(map(tuple, found.collect())) == [(1, p, 10.0, 10.0, 130.0, 60.0, 2) for p in range(3)] + [(2, 0, 0.0, 0.0, 480.0, 320.0, 1)]
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
