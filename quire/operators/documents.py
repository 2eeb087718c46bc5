"""Whole documents: parts across pages, selections, annotations, structured documents, archives."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import same_list_next
from quire.operators.rounds import settled
from quire.sources.archives import rtf_text
from quire.sources.text_formats import decoded, kind_of

#: Signs that end a part of a text, and marks that begin an item.
STOP = r"[.!?。？！…:：\"”』」)\]]\z"
ITEM = r"^\s*(?:[□■◆◇○●•▶ㅇo\-–*※]|\(?[0-9]{1,3}[.)]|[①-⑳㉠-㉭ⓐ-ⓩ])"


def list_breaks(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, reason): lines that begin an item whatever their place: two labels with values in a row, two lines
    that begin with the same sign and a space, or the next mark of a list."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    first = lambda c: F.substring_index(c, " ", 1)
    label = lambda c: F.col(c).rlike(r"^[^\s:：.!?。][^:：.!?。]{0,18}\s*[:：]\s+\S") & ~F.col(c).rlike(r"^[^:：]*[0-9]\s*[:：]\s*[0-9]")
    rows = lines.withColumn("prev", F.lag("text").over(w)).filter("prev is not null")
    sign = first("text").rlike(r"^[^\p{L}\p{N}\s]\z") & (first("prev") == first("text")) & F.col("text").contains(" ")
    mark = r"^(?:[0-9]{1,2}[.)]|\([0-9]{1,2}\)|[①-⑳]|[a-z][.)]|[A-Z][.)]|[가-하][.)])\z"
    follows = first("text").rlike(mark) & first("prev").rlike(mark) & same_list_next(first("prev"), first("text")) & F.col("text").contains(" ")
    reason = F.when(label("prev") & label("text"), "labels").when(sign, "same sign").when(follows, "next mark")
    return rows.select("doc_id", "line_no", reason.alias("reason")).filter("reason is not null")


def continued_parts(parts: DataFrame) -> DataFrame:
    """(doc_id, part_no): parts that go on with the last one of the page before: the first main part of their page, where that
    page's last main part does not end a sentence, with a panel's text between both. parts: doc_id, part_no, page, text,
    is_panel, heading; main parts are those outside panels."""
    main = parts.filter("not is_panel")
    w = Window.partitionBy("doc_id").orderBy("part_no")
    before = {f"p_{c}": F.lag(c).over(w) for c in ("part_no", "page", "text", "heading")}
    edge = Window.partitionBy("doc_id", "page")
    rows = main.withColumns(before | {"first": F.min("part_no").over(edge)})
    panels = F.sum(F.col("is_panel").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = parts.withColumn("panels", panels).select("doc_id", "part_no", "panels")
    rows = rows.join(seen, ["doc_id", "part_no"]).join(seen.select("doc_id", F.col("part_no").alias("p_part_no"), F.col("panels").alias("p_panels")), ["doc_id", "p_part_no"])
    good = (F.col("page") == F.col("p_page") + 1) & (F.col("first") == F.col("part_no")) & (F.col("panels") > F.col("p_panels")) & ~F.trim("p_text").rlike(STOP) & ~F.col("text").rlike(ITEM) & (F.col("heading") == 0) & (F.col("p_heading") == 0)
    return rows.filter(good).select("doc_id", "part_no")


def chosen_parts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, para, part, first_line, n_lines): paragraphs (lines: doc_id, para, line_no, page) cut where pages are left out;
    wanted: doc_id, page. A paragraph's parts are numbered from 0."""
    w = Window.partitionBy("doc_id", "para").orderBy("line_no")
    kept = lines.withColumn("i", F.row_number().over(w)).join(wanted.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    island = kept.withColumn("island", F.col("i") - F.row_number().over(w))
    grouped = island.groupBy("doc_id", "para", "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))
    return grouped.withColumn("part", F.row_number().over(Window.partitionBy("doc_id", "para").orderBy("island")) - 1).drop("island")


def selected_text(lines: DataFrame, joins: DataFrame) -> DataFrame:
    """(doc_id, text): selected lines joined as their seams say: paragraphs by a line end, words by a space; a hyphen that a
    seam drops goes. The first line's own seam says nothing."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.join(joins.select("doc_id", "line_no", "kind"), ["doc_id", "line_no"], "left")
    after = F.lead("kind").over(w)
    piece = F.when(after == "hyphen-drop", F.regexp_replace("text", "-\\z", "")).otherwise(F.concat("text", F.when(after == "space", " ").when(after == "para", "\n").otherwise("")))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "piece")))
    return rows.withColumn("piece", piece).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))


def flow_order(lines: DataFrame, inserts: DataFrame) -> DataFrame:
    """(doc_id, place, line_no, box_id): lines, and boxes (doc_id, box_id, before_line) each before its line, those of one line
    by id; boxes without a line come last."""
    mine = lines.select("doc_id", F.col("line_no").alias("anchor"), F.lit(1).alias("kind"), "line_no", F.lit(None).cast("int").alias("box_id"))
    boxes = inserts.select("doc_id", F.coalesce("before_line", F.lit(2**31 - 1)).cast("int").alias("anchor"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("line_no"), F.col("box_id").cast("int").alias("box_id"))
    w = Window.partitionBy("doc_id").orderBy("anchor", "kind", "box_id")
    return mine.unionByName(boxes).withColumn("place", F.row_number().over(w)).select("doc_id", "place", "line_no", "box_id")


def first_occurrences(rows: DataFrame, keys: list[str], same: list[str], order: list[str]) -> DataFrame:
    """rows with number: within keys, which of the distinct values of `same` each has, numbered from 1 as they first occur.
    Values that first occur at one place go by the values themselves."""
    first = rows.groupBy(*keys, *same).agg(F.min(F.struct(*order)).alias("_first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("_first", *same))).drop("_first")
    return rows.join(numbered, [*keys, *same])


def clean_highlights(marks: DataFrame, longest: int | None = None, far: float | None = None, usual: str = "#ffe066") -> DataFrame:
    """marks (doc_id, id, page, color, text, rects) as they may be stored: places and sizes from 0, pages from 0, colours of six
    digits; marks without any extent are left out. Where limits are asked for, places and sizes go up to `far`, and texts have
    `longest` characters at most."""
    above = lambda x: F.greatest(F.lit(0.0), F.coalesce(x.cast("double"), F.lit(0.0)))
    within = lambda x: above(x) if far is None else F.least(F.lit(far), above(x))
    whole = F.coalesce("text", F.lit(""))
    rects = F.transform("rects", lambda r: F.struct(*(within(r[c]).alias(c) for c in ("x", "y", "w", "h"))))
    page = F.greatest(F.lit(0), F.floor(F.coalesce("page", F.lit(0)))).cast("int")
    color = F.when(F.col("color").rlike("^#[0-9a-fA-F]{6}\\z"), F.col("color")).otherwise(usual)
    out = marks.select("doc_id", "id", page.alias("page"), color.alias("color"), (whole if longest is None else F.left(whole, F.lit(longest))).alias("text"), rects.alias("rects"))
    return out.filter(F.exists("rects", lambda r: (r["w"] > 0) & (r["h"] > 0)))


def merged_rects(rects: DataFrame, apart: float = 1.0) -> DataFrame:
    """(doc_id, id, y, h, x, w): rectangles (doc_id, id, x, y, w, h) of a mark on one height as one where they meet."""
    row = Window.partitionBy("doc_id", "id", "y", "h").orderBy("x", "w")
    before = F.max(F.col("x") + F.col("w")).over(row.rowsBetween(Window.unboundedPreceding, -1))
    numbered = rects.withColumn("_new", F.when(F.col("x") <= before + apart, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "id", "y", "h", "_part").agg(F.min("x").alias("x"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w")).drop("_part")


# structured documents

_COLOR = "struct<color:struct<rgbColor:struct<red:double,green:double,blue:double>>>"
_RUN = f"struct<content:string,textStyle:struct<bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,foregroundColor:{_COLOR},fontSize:struct<magnitude:double>,weightedFontFamily:struct<fontFamily:string>,link:struct<url:string>>>"
_PARAGRAPH = f"struct<elements:array<struct<textRun:{_RUN}>>,paragraphStyle:struct<namedStyleType:string,alignment:string>>"
_TAB = f"tabProperties:struct<title:string>,documentTab:struct<body:struct<content:array<struct<paragraph:{_PARAGRAPH}>>>>"
#: Tabs may hold tabs, as deep as they like: those are read from their own text, level by level.
DOCUMENT = f"struct<title:string,tabs:array<string>,body:struct<content:array<struct<paragraph:{_PARAGRAPH}>>>>"
TAB = f"struct<{_TAB},childTabs:array<string>>"
#: Named styles and alignments.
HEADINGS = {"TITLE": 1, "HEADING_1": 1, "HEADING_2": 2, "HEADING_3": 3, "HEADING_4": 4, "HEADING_5": 5, "HEADING_6": 6}
ALIGNS = {"CENTER": "center", "END": "right", "JUSTIFIED": "justify"}


def _mapped(x: Column, names: dict, rest: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in names.items() for v in kv)), x), rest)


def structured_runs(docs: DataFrame, column: str = "json") -> DataFrame:
    """(doc_id, tab, tab_name, block_no, heading, align, run_no, text, b, i, u, s, size, color): the runs of documents in the JSON
    of an editor's service: tabs in the order of their tree, paragraphs, and their runs; line breaks inside a run end it.
    Empty paragraphs at a tab's end are left out; others have one run of null text."""
    d = docs.select("doc_id", F.from_json(F.col(column), DOCUMENT).alias("d")).filter("d is not null")
    part = lambda name, content: F.struct(F.col(name).alias("name"), F.col(content).alias("content")).alias("t")
    found = [d.filter("coalesce(size(d.tabs), 0) <= 0").select("doc_id", F.array(F.lit(0)).alias("path"), part("d.title", "d.body.content"))]
    level = d.select("doc_id", F.array().cast("array<int>").alias("path"), F.col("d.tabs").alias("inner"))
    while True:  # as often as tabs stand in tabs
        below = level.select("doc_id", "path", F.posexplode("inner").alias("k", "text"))
        read = below.select("doc_id", F.concat("path", F.array("k")).alias("path"), F.from_json("text", TAB).alias("s"))
        found.append(read.select("doc_id", "path", part("s.tabProperties.title", "s.documentTab.body.content")))
        level = settled(read.filter("size(s.childTabs) > 0").select("doc_id", "path", F.col("s.childTabs").alias("inner")), "tabs")
        if level.isEmpty():
            break
    # arrays compare as their first unlike elements do, so a tab comes right before those that it holds
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    tabs = reduce(DataFrame.unionByName, found).select("doc_id", number.alias("tab"), "t")
    content = F.filter("t.content", lambda c: c["paragraph"].isNotNull())
    blocks = tabs.select("doc_id", "tab", F.col("t.name").alias("tab_name"), F.posexplode(F.transform(content, lambda c: c["paragraph"])).alias("block_no", "p"))

    def split(e: Column) -> Column:
        style = e["textRun"]["textStyle"]
        flag = lambda n: F.coalesce(style[n], F.lit(False))
        rgb = style["foregroundColor"]["color"]["rgbColor"]
        part = lambda c: F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(rgb[c], F.lit(0.0)))) * 255 + 0.5)), 2, "0")
        color = F.when(rgb.isNotNull(), F.concat(part("red"), part("green"), part("blue")))
        texts = F.split(F.regexp_replace(e["textRun"]["content"], "\\n\\z", ""), "\\x0B")
        fields = (flag("bold").alias("b"), flag("italic").alias("i"), (flag("underline") & style["link"].isNull()).alias("u"), flag("strikethrough").alias("s"), style["fontSize"]["magnitude"].alias("size"), color.alias("color"))
        return F.transform(F.filter(texts, lambda t: t != ""), lambda t: F.struct(t.alias("text"), *fields))

    runs = F.flatten(F.transform(F.filter("p.elements", lambda e: e["textRun"].isNotNull()), split))
    heading, align = _mapped(F.col("p.paragraphStyle.namedStyleType"), HEADINGS, F.lit(0)), _mapped(F.col("p.paragraphStyle.alignment"), ALIGNS, F.lit("left"))
    made = blocks.select("doc_id", "tab", "tab_name", "block_no", heading.alias("heading"), align.alias("align"), F.coalesce(runs, F.array()).alias("runs"))
    after = F.max(F.when(F.size("runs") > 0, F.col("block_no"))).over(Window.partitionBy("doc_id", "tab"))
    kept = made.withColumn("last", after).filter("block_no <= last")
    return kept.select("doc_id", "tab", "tab_name", "block_no", "heading", "align", F.posexplode_outer("runs").alias("run_no", "r")).select("doc_id", "tab", "tab_name", "block_no", "heading", "align", F.coalesce("run_no", F.lit(0)).alias("run_no"), "r.*")


def markdown_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, block_no, text): blocks of runs (doc_id, block_no, heading, run_no, text, b, i, s) as Markdown: marks around what is
    bold, italic or struck, outside the white space at its ends; headings by their level."""
    plain = F.regexp_replace("text", r"([\\\\`*_\[\]#|])", r"\\\\$1")
    head, tail = F.regexp_extract(plain, r"^(\s*)", 1), F.regexp_extract(plain, r"(?<!\s)(\s*)\z", 1)
    core = F.regexp_replace(plain, r"^\s+|(?<!\s)\s+\z", "")
    around = F.concat(F.when(F.col("s"), "~~").otherwise(""), F.when(F.col("b"), "**").otherwise(""), F.when(F.col("i"), "*").otherwise(""))
    marked = F.when(core == "", plain).otherwise(F.concat(head, around, core, F.reverse(around), tail))
    parts = F.array_sort(F.collect_list(F.struct("run_no", F.coalesce(marked, F.lit("")).alias("t"))))
    out = runs.groupBy("doc_id", "block_no", "heading").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("t"))
    return out.select("doc_id", "block_no", F.concat(F.when(F.col("heading") > 0, F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "))).otherwise(""), "t").alias("text"))


# archives


def zipped(members: DataFrame, when: tuple = (1980, 1, 1, 0, 0, 0)) -> DataFrame:
    """(doc_id, content): members (doc_id, name, data) of each document as a zip file, by name; null data is empty. One document is one small group."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in sorted(zip(rows["name"], rows["data"])):
                z.writestr(zipfile.ZipInfo(name, when), bytes(data or b""), zipfile.ZIP_DEFLATED)
        return pd.DataFrame([(rows["doc_id"].iloc[0], out.getvalue())], columns=["doc_id", "content"])

    return members.select("doc_id", "name", "data").groupBy("doc_id").applyInPandas(work, "doc_id long, content binary")


def web_document(title: Column, body: Column) -> Column:
    """A page of its own around the HTML of a document."""
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body>"), body, F.lit("</body></html>"))


def run_offsets(runs: DataFrame) -> DataFrame:
    """runs (doc_id, block_no, run_no, text) with start and stop: their places in the text of their block, from 0."""
    w = Window.partitionBy("doc_id", "block_no").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    return runs.withColumn("start", start).withColumn("stop", F.col("start") + F.length("text"))


def imported(files: DataFrame) -> DataFrame:
    """(doc_id, name, kind, text): files (doc_id, name, content) by what their names say they are; texts of any encoding are
    decoded, RTF becomes its text, and zip-based kinds, whose readers open them themselves, have none. Refused and unknown kinds
    stay, so that a caller sees them."""
    kind = kind_of(F.col("name"))
    rows = files.withColumn("kind", kind).withColumn("text", F.when(kind.isin("text", "markdown", "csv", "html", "rtf"), decoded(F.col("content"))))
    rich = rtf_text(rows.filter("kind = 'rtf'").select("doc_id", F.col("text").alias("content")))
    plain = rows.filter("kind is null or kind <> 'rtf'").select("doc_id", "name", "kind", "text")
    return plain.unionByName(rows.filter("kind = 'rtf'").select("doc_id", "name", "kind").join(rich, "doc_id"))
