"""Rules on small relations with rows written by hand, greedy steps, importers and the stream."""

import io
import zipfile

from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import boxes, documents, flow, geometry, lines, segments, vocabulary
from quire.plans import exports
from quire.sources import archives, html_blocks, text_formats
from quire.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def column(spark, f, *values):
    return [r[0] for r in texts(spark, *values).orderBy("i").select(f(F.col("t"))).collect()]


def test_marks(spark):
    assert column(spark, S.mark_shape, "12.", "b)", "ㄴ.", "③", "(7)") == ["9.", "a)", "ㄱ.", "①", "(9)"]
    assert column(spark, S.mark_order, "12.", "c)", "다.", "③", "四", "•", "ⓑ") == [12, 3, 3, 3, 4, None, 2]
    got = column(spark, S.list_mark, "• a", "3. x", "(4) y", "⑤z", "나. w", "b) v", "C. u", "3.5 no", "text", "-x", "12) two")
    assert [g and tuple(g) for g in got] == [("b", "b•", None, 2), ("n", "n0.", 3, 3), ("n", "n0()", 4, 4), ("n", "n1", 5, 1), ("n", "n8.", 2, 3), ("n", "n5)", 2, 3), ("n", "n4.", 3, 3), None, None, None, ("n", "n0)", 12, 4)]


def test_lines_by_kind(spark):
    assert column(spark, S.is_toc_line, "One ..... 12", "Two … 3", "x....iv", "a.b 3") == [True, False, True, False]
    assert tuple(column(spark, S.toc_entry, "One .... 12")[0]) == ("One", "12")
    assert column(spark, S.is_label_line, "Name: x", "at 12:30 now", "no colon", "a.b: x", "이름： 값") == [True, False, False, False, True]
    assert column(spark, S.page_list, "1-3, 5", "3-1,1", "x", "", " 2 ") == [[0, 1, 2, 4], [0, 1, 2], None, None, [1]]
    assert column(spark, S.stem, "학교에서", "에서", "집을", "abc") == ["학교", "에서", "집", "abc"]
    assert column(spark, S.word_core, "“quoted”,", "...", "a-b", "(x)") == ["quoted", "", "a-b", "x"]
    assert column(spark, S.digits_masked, " 12 a 3 ", "x") == ["# a #", "x"]
    assert column(spark, lambda t: S.script_share(t, "latin"), "abc가", "...", "日本a") == [0.75, 0.5, 1 / 3]


def test_heading_levels(spark):
    cases = [("T", 20.0, False, 1), ("T", 14.0, False, 2), ("T", 12.0, False, 3), ("T", 10.0, True, 3), ("T", 10.0, False, 0), ("label: v", 11.0, True, 0), ("LOUD", 10.7, False, 3), ("x" * 121, 30.0, True, 0), ("", 30.0, True, 0), ("s" * 60 + ".", 13.0, True, 0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, size double, bold boolean, want int")
    got = df.orderBy("i").select(S.heading_level(F.col("t"), F.col("size"), F.lit(10.0), F.lit(1), F.col("bold"), F.lit(False)).alias("l"), "want").collect()
    assert [r.l for r in got] == [r.want for r in got]


def doc(spark, *values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "doc_id long, line_no int, text string")


def test_seams_and_paragraphs(spark):
    d = doc(spark, "a long first line that is full of wor-", "ds and goes on to the very end of it al", "short end.", "New paragraph that begins after a short", "• item", "", "last")
    kinds = {r.line_no: r.kind for r in flow.seams(d).collect()}
    assert kinds == {1: "hyphen-drop", 2: "space", 3: "para", 4: "para", 5: "para", 6: "para"}
    paras = flow.paragraphs(d, flow.seams(d)).orderBy("para_no").collect()
    assert [p.text for p in paras] == ["a long first line that is full of words and goes on to the very end of it al short end.", "New paragraph that begins after a short", "• item", "", "last"]
    assert rows(flow.kept_whole(d, flow.paragraphs(d, flow.seams(d)))) == [(1, True)]


def test_lists(spark):
    d = doc(spark, "1. a", "text", "2. b", "9. far", "• x", "• y", "3. c", "(1) alone")
    assert [(r.line_no, r.key, r.starts) for r in flow.list_items(d).orderBy("line_no").collect()] == [(0, "n0.", True), (2, "n0.", False), (4, "b•", True), (5, "b•", False)]


def test_runs_chapters_tabs(spark):
    runs = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate([("b", "x"), ("b", "y"), (None, "z"), (None, "w"), ("b", "v")])], "doc_id long, pos int, style string, text string")
    assert [(r.style, r.text) for r in flow.merged_runs(runs).orderBy("run_no").collect()] == [("b", "xy"), (None, "zw"), ("b", "v")]
    blocks = spark.createDataFrame([(1, i, h) for i, h in enumerate([0, 2, 0, 3, 2, 0])], "doc_id long, block_no int, heading int")
    assert [r.chapter for r in flow.chapters(blocks).orderBy("block_no").collect()] == [0, 1, 1, 1, 2, 2]
    assert [r.chapter for r in flow.chapters(blocks.filter("block_no > 0")).orderBy("block_no").collect()] == [0, 0, 0, 1, 1]
    starts = spark.createDataFrame([(1, 0, 2), (1, 1, 5)], "doc_id long, tab_no int, first int")
    assert rows(flow.tab_ranges(starts, spark.createDataFrame([(1, 9)], "doc_id long, last int"))) == [(1, 0, 2, 4), (1, 1, 5, 9)]
    at = spark.createDataFrame([(1, n) for n in (1, 2, 4, 7)], "doc_id long, line_no int")
    assert [r.tab_no for r in flow.of_tab(at, starts).orderBy("line_no").collect()] == [None, 0, 0, 1]


def test_vocabulary(spark):
    d = doc(spark, "go to the school now", "the school,", "x to the y")
    got = {r.token: (r.n_all, r.n_inner) for r in vocabulary.dictionary(d).collect()}
    assert got["the"] == (3, 2) and got["school"] == (2, 1) and got["go"] == (1, 0)
    assert rows(vocabulary.token_pairs(d)) == [("the", "school", 2), ("to", "the", 2)]
    words = spark.createDataFrame([("학교",), ("x",)], "base string")
    counted = spark.createDataFrame([("학교", 2), ("학교에서", 3), ("학교들", 9)], "token string, n_all long")
    assert rows(vocabulary.word_families(words, counted)) == [("x", 0), ("학교", 5)]


def boxes_of(spark, *bs):
    return spark.createDataFrame([(1, 0, i, *map(float, b)) for i, b in enumerate(bs)], "doc_id long, page int, box_id long, x0 double, y0 double, x1 double, y1 double")


def test_boxes(spark):
    b = boxes_of(spark, (0, 0, 10, 10), (1, 1, 10, 10), (20, 0, 30, 10), (11, 0, 19, 10), (50, 50, 60, 60))
    kept = boxes.suppressed(b.withColumn("score", F.element_at(F.array(*map(F.lit, (0.5, 0.9, 0.8, 0.8, 0.1))), (F.col("box_id") + 1).cast("int"))))
    assert [r[2] for r in rows(kept)] == [1, 2, 3, 4]
    assert [r[2:] for r in rows(boxes.touching_groups(b))] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)]
    assert [r[2:] for r in rows(boxes.grown_boxes(b))] == [(0, 0, 10, 10, 2), (11, 0, 19, 10, 1), (20, 0, 30, 10, 1), (50, 50, 60, 60, 1)]
    assert [r[2:] for r in rows(boxes.grown_boxes(b, pad=1))][0] == (0, 0, 30, 10, 4)
    shuffled = b.orderBy(F.desc("box_id"))
    assert rows(boxes.touching_groups(shuffled)) == rows(boxes.touching_groups(b))
    g = spark.createDataFrame([(1, 0, i, y, 10.0) for i, y in enumerate([0.0, 4.0, 8.0, 9.0, 20.0])], "doc_id long, page int, ci long, oy double, size double")
    assert [r.row_no for r in boxes.anchored_rows(g).orderBy("ci").collect()] == [0, 0, 1, 1, 2]
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 2), (1, 0, 0, 1, 2, 1), (1, 0, 1, 0, 1, 1)], "doc_id long, page int, row int, cell_no int, colspan int, rowspan int")
    assert [r.col for r in boxes.table_grid(cells).orderBy("row", "cell_no").collect()] == [0, 1, 1]


def test_geometry(spark):
    i = spark.createDataFrame([(1, 0, 5), (1, 4, 6), (1, 9, 12), (2, 0, 1)], "k int, low int, high int")
    assert rows(geometry.merged_intervals(i, "k")) == [(1, 1, 0, 6, 2), (1, 2, 9, 12, 1), (2, 1, 0, 1, 1)]
    b = boxes_of(spark, (0, 0, 100, 10), (0, 12, 40, 20), (60, 12, 100, 20), (0, 22, 40, 30)).withColumn("seq", F.col("box_id"))
    assert [r.box_id for r in geometry.reading_order(b, 100.0).orderBy("place").collect()] == [0, 1, 3, 2]
    assert rows(geometry.covered_boxes(b.unionByName(boxes_of(spark, (0, 0, 50, 40)).selectExpr("doc_id", "page", "box_id + 9 AS box_id", "x0", "y0", "x1", "y1", "9L AS seq")))) == [(1, 0, 1), (1, 0, 3)]


def test_lines(spark):
    d = spark.createDataFrame([(1, "Head 1\nbody\nx"), (2, "Head 2\nother"), (3, "Head 1\nbody\nx"), (4, None)], "doc_id long, text string")
    assert rows(lines.repeated_lines(d)) == [("Head #", 3, 2)]
    assert rows(lines.body_lines(d)) == [(1, 1, "body"), (1, 2, "x"), (2, 1, "other"), (3, 1, "body"), (3, 2, "x")]
    assert rows(lines.joined_glyphs(lines.glyphs(lines.split_lines(d)))) == rows(lines.split_lines(d))
    assert rows(lines.whole_copies(d, least=2)) == [(1, 2)]


def test_formats(spark):
    df = spark.createDataFrame([(0, b"\xef\xbb\xbfa"), (1, b"\xff\xfea\x00"), (2, "é".encode()), (3, "가".encode("cp949")), (4, b"\xfe\xff\x00b")], "i int, b binary")
    assert [r[0] for r in df.orderBy("i").select(text_formats.decoded(F.col("b"))).collect()] == ["a", "a", "é", "가", "b"]
    assert column(spark, text_formats.kind_of, "a.DOCX", "b.md", "c.doc", "d.xyz") == ["parts", "markdown", "old format", None]
    d = spark.createDataFrame([(1, 'a;b;"c;1"\nd;"e ""q""\nf";')], "doc_id long, text string")
    assert rows(text_formats.csv_cells(d)) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "c;1"), (1, 1, 0, "d"), (1, 1, 1, 'e "q"\nf'), (1, 1, 2, "")]
    assert column(spark, text_formats.inline_html, "**b** *i* ~~s~~ `c` <") == ["<b>b</b> <i>i</i> <s>s</s> <code>c</code> &lt;"]
    m = text_formats.markdown_blocks(doc(spark, "# T", "```", "# not", "```", "- x", "", "| a |")).orderBy("line_no").collect()
    assert [(r.kind, r.level, r.body) for r in m] == [("heading", 1, "T"), ("code", 0, "# not"), ("item", 0, "x"), ("blank", 0, ""), ("row", 0, "| a |")]


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def test_archives(spark):
    w = 'xmlns:w="http://w"'
    rels = '<R><Relationship Type="http://x/relationships/officeDocument" Target="/d/main.xml"/></R>'
    docx = packed(**{"_rels/.rels": rels}, d__main_dot_xml=f'<w:d {w}><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:d>')
    xlsx = packed(xl__sharedStrings_dot_xml="<s><si><t>hi</t></si></s>", xl__worksheets__sheet1_dot_xml='<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="B5"><v>8</v></c></row></w>')
    epub = packed(o__c_dot_opf='<p><item id="a" href="1.xhtml"/><item id="b" href="2.xhtml"/><itemref idref="b"/><itemref idref="a"/></p>', o__1_dot_xhtml="<p>one</p>", o__2_dot_xhtml="<p>two</p>")
    files = spark.createDataFrame([(1, docx), (2, xlsx), (3, epub), (4, b"broken")], "doc_id long, content binary")
    assert [(r.kind, r.level, r.text) for r in archives.docx_blocks(files).orderBy("block_no").collect()] == [("heading", 2, "T"), ("paragraph", 0, "a\tb")]
    assert rows(archives.xlsx_cells(files)) == [(2, 1, 0, 0, "hi"), (2, 1, 0, 2, "7"), (2, 1, 1, 1, "8")]
    assert [(r.chapter, r.html) for r in archives.epub_chapters(files).orderBy("chapter").collect()] == [(0, "<p>two</p>"), (1, "<p>one</p>")]
    rtf = spark.createDataFrame([(1, r"{\rtf1{\fonttbl{\f0 A;}}\b Hi\b0\par \u233?t\'e9}")], "doc_id long, content string")
    assert rows(archives.rtf_text(rtf)) == [(1, "Hi\nété")]


def test_html_and_exports(spark):
    page = spark.createDataFrame([(1, "<head><title>t</title></head><h1>A &amp; B</h1><ul><li>x<li>y</ul><script>no</script><p>z<br>w")], "page_id long, html string")
    assert [(r.tag, r.depth, r.text) for r in html_blocks.html_blocks(page).orderBy("block_no").collect()] == [("h1", 0, "A & B"), ("li", 1, "x"), ("li", 1, "y"), ("p", 0, "z w")]
    b = spark.createDataFrame([(1, 0, 1, "T*"), (1, 1, 0, "a<b")], "doc_id long, block_no int, heading int, text string")
    assert rows(exports.markdown(b)) == [(1, "# T\\*\n\na<b")]
    assert rows(exports.block_html(b)) == [(1, "<h1>T*</h1>\n<p>a&lt;b</p>")]
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 1, "d|")], "doc_id long, row int, col int, text string")
    assert rows(exports.markdown_tables(cells)) == [(1, "| a | b |\n| --- | --- |\n|  | d\\| |")]


def test_stream(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    for batch, text in ((0, "a\nb\na"), (1, "a\nc")):
        spark.createDataFrame([(batch, text)], incremental.DOCUMENTS).write.mode("append").parquet(source)
        incremental.run_once(incremental.line_counts(incremental.documents_stream(spark, source)), out, mark)
    assert rows(incremental.latest(spark, out)) == [("a", 3), ("b", 1), ("c", 1)]


def test_long_cells_and_groups(spark):
    """Sizes that patterns with loops over alternatives could not take."""
    big = "x" * 1_000_000
    texts = [(1, f'"{big}",b\n"a""{big}"\n'), (2, f"{big},{big}"), (3, '"open, to the end\nof the text'), (4, "\n\na"), (5, ""), (6, None), (7, 'x"y,"z,"\r\nb')]
    cells = {}
    for r in text_formats.csv_cells(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        cells.setdefault(r.doc_id, {})[r.row, r.col] = r.value
    assert cells[1] == {(0, 0): big, (0, 1): "b", (1, 0): 'a"' + big} and cells[2] == {(0, 0): big, (0, 1): big}
    assert cells[3] == {(0, 0): "open, to the end\nof the text"} and cells[4] == {(0, 0): "", (1, 0): "", (2, 0): "a"} and not {5, 6} & set(cells)
    assert cells[7] == {(0, 0): "xy,z", (0, 1): "\r\nb"}
    many = spark.createDataFrame([(1, "\n".join(f"{i};2" for i in range(3000)))], "doc_id long, text string")
    assert text_formats.csv_cells(many).count() == 6000 and text_formats.csv_cells(many, most=10).count() == 20
    rtf = [(1, r"{\rtf1{\pict " + "0a" * 500_000 + r"}a\par " + "{" * 3000 + r"b" + "}" * 3000 + r"\u8364?\'e9}"), (2, None), (3, r"{\rtf1\ansicpg949{\*\x y}\'b0\'a1}")]
    assert [r.text for r in archives.rtf_text(spark.createDataFrame(rtf, "doc_id long, content string")).orderBy("doc_id").collect()] == ["a\nb€é", None, "가"]
    lines = spark.createDataFrame([("." * 20_000,), ("T " + "." * 20_000 + " 7",), (" " * 100_000 + "x" + " " * 100_000 + "y" + " " * 9,)], "text string")
    got = lines.select(S.toc_entry("text").alias("e"), F.length(S.digits_masked("text")).alias("n")).collect()
    assert [r.e and (r.e.title, r.e.page) for r in got] == [None, ("T", "7"), None] and got[2].n == 100_002


def test_damaged_files(spark):
    import struct

    good = packed(a_dot_xml="<a/>", b_dot_xml="<b><t>x</t></b>")
    bad = bytearray(good)
    at = bad.index(b"<b>") if b"<b>" in bad else struct.unpack("<I", b"\0\0\0\0")[0] + 60
    bad[at] ^= 0xFF
    files = spark.createDataFrame([(1, good), (2, bytes(bad)), (3, b""), (4, None), (5, good[: len(good) // 2])], "doc_id long, content binary")
    names = {}
    for r in archives.members(files).collect():
        names.setdefault(r.doc_id, set()).add(r.name)
    assert names[1] == {"a.xml", "b.xml"} and set(names) <= {1, 2}
    broken = packed(**{"_rels/.rels": "<R>", "x.opf": "<p", "xl/worksheets/sheet1.xml": "<w><row>", "content.xml": "<not", "ppt/slides/slide1.xml": ""})
    one = spark.createDataFrame([(1, broken)], "doc_id long, content binary")
    for read in (archives.docx_blocks, archives.odt_blocks, archives.pptx_blocks, archives.xlsx_cells, archives.epub_chapters):
        assert read(one).collect() == []
    odt = packed(content_dot_xml='<d xmlns:t="u"><t:h t:outline-level="2">H</t:h><t:p>a<t:s/>b</t:p></d>')
    pptx = packed(ppt__slides__slide2_dot_xml="<s><p><t>two</t></p></s>", ppt__slides__slide10_dot_xml="<s><p><t>ten</t></p><p/></s>")
    both = spark.createDataFrame([(1, odt), (2, pptx)], "doc_id long, content binary")
    assert [(r.kind, r.level, r.text) for r in archives.odt_blocks(both).orderBy("block_no").collect()] == [("heading", 2, "H"), ("paragraph", 0, "a b")]
    assert [(r.slide, r.text) for r in archives.pptx_blocks(both).orderBy("slide").collect()] == [(2, "two"), (10, "ten")]


def test_elements_without_an_end(spark):
    pages = [(1, "<p>a</p><embed><p>b</p>"), (2, "<head><title>t</title><body><p>c</p>"), (3, "<p>a<script>x</script></p><object><p>no</p></object>d"), (4, "</iframe>e")]
    got = html_blocks.html_blocks(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id", "block_no").collect()
    assert [(r.page_id, r.text) for r in got] == [(1, "a"), (1, "b"), (2, "c"), (3, "a"), (3, "d"), (4, "e")]


def test_fragments_and_structured_documents(spark):
    rows_ = [(1, 0, 0, "11.", 0.0, 0.0, 12.0, 10.0), (1, 0, 1, "after", 20.0, 1.0, 60.0, 10.0), (1, 0, 2, "far", 200.0, 0.0, 230.0, 10.0), (1, 0, 3, "below", 0.0, 20.0, 40.0, 30.0)]
    df = spark.createDataFrame(rows_, "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.text, r.n) for r in segments.joined_fragments(df).orderBy("line_no").collect()] == [("11. after", 2), ("far", 1), ("below", 1)]
    doc = """{"title": "T", "tabs": [{"tabProperties": {"title": "A"}, "documentTab": {"body": {"content": [{"paragraph": {"elements": [{"textRun": {"content": "one\\u000btwo\\n", "textStyle": {"italic": true}}}]}}, {"paragraph": {"elements": []}}]}},
        "childTabs": [{"tabProperties": {"title": "B"}, "documentTab": {"body": {"content": [{"paragraph": {"elements": []}}, {"paragraph": {"elements": [{"textRun": {"content": "x"}}], "paragraphStyle": {"alignment": "END"}}}]}}}]}]}"""
    flat = """{"title": "F", "body": {"content": [{"paragraph": {"elements": [{"textRun": {"content": "y"}}]}}, {"sectionBreak": {}}]}}"""
    got = documents.structured_runs(spark.createDataFrame([(1, doc), (2, flat), (3, "{}"), (4, None), (5, "no json")], "doc_id long, json string"))
    assert [(r.doc_id, r.tab, r.tab_name, r.block_no, r.run_no, r.text, r.i, r.align) for r in got.orderBy("doc_id", "tab", "block_no", "run_no").collect()] == [
        (1, 0, "A", 0, 0, "one", True, "left"), (1, 0, "A", 0, 1, "two", True, "left"), (1, 1, "B", 0, 0, None, None, "left"), (1, 1, "B", 1, 0, "x", False, "right"), (2, 0, "F", 0, 0, "y", False, "left")
    ]
    assert column(spark, lambda t: S.symbol_sign(F.lit("Wingdings"), t), "\uf06c", "é", " ", "■", "") == ["●", "•", " ", "■", ""]
