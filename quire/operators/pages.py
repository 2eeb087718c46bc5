"""Pages of lines and boxes: what is visible, what is furniture, how columns and paragraphs are set.

Lines are rows of (doc_id, page, line_no, text, x0, x1, oy, size, weight, angle, page_w, page_h), boxes of (doc_id, page,
box_id, seq, x0, y0, x1, y1). Every join has an equality on the document and the page, or on the document and a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quire.functions.scalars import box_area, digits_masked, escaped, half_up, overlap_area
from quire.operators.boxes import grown_boxes
from quire.operators.lines import duplicate_pages, gathered
from quire.operators.ranks import at_ranks
from quire.operators.rounds import settled

PAGE = ["doc_id", "page"]
#: Less than 8 points.
APART = 8 - 1e-9


def _boxes(boxes: DataFrame, p: str, *more: str) -> DataFrame:
    return boxes.select(*PAGE, *(F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1", *more)))


def _turn(angle: Column) -> Column:
    """An angle as 0 up to a full turn."""
    return F.pmod(angle, F.lit(2 * pi))


# filters


def visible(rows: DataFrame, images: DataFrame, share: float = 0.4) -> DataFrame:
    """rows (doc_id, page, seq, x0, y0, x1, y1, page_w, page_h) whose centre is on the page and under no opaque image that
    is drawn later and covers `share` of the page. images: boxes with has_alpha, page_w and page_h."""
    on_page = F.greatest(F.lit(0.0), F.least("page_w", "x1") - F.greatest(F.lit(0.0), "x0")) * F.greatest(F.lit(0.0), F.least("page_h", "y1") - F.greatest(F.lit(0.0), "y0"))
    covers = _boxes(images.filter(~F.col("has_alpha") & (on_page >= share * F.col("page_w") * F.col("page_h"))), "c_", "seq")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    under = (F.col("seq") >= 0) & (F.col("c_seq") > F.col("seq")) & (x > F.col("c_x0")) & (x < F.col("c_x1")) & (y > F.col("c_y0")) & (y < F.col("c_y1"))
    inside = rows.filter(x.between(0, F.col("page_w")) & y.between(0, F.col("page_h"))).alias("r")
    same = (F.col("r.doc_id") == F.col("c.doc_id")) & (F.col("r.page") == F.col("c.page"))
    return inside.join(covers.alias("c"), same & under, "left_anti")


def set_kind(angle: Column, invisible: Column) -> Column:
    """graphic for invisible and tilted text (more than 0.02 off a full turn), else text."""
    a = _turn(angle)
    return F.when(invisible | ((a > 0.02) & (a < 2 * pi - 0.02)), "graphic").otherwise("text")


def is_upright(angle: Column) -> Column:
    a = _turn(angle)
    return (a < 0.3) | (a > 2 * pi - 0.3)


def raster_documents(pages: DataFrame, most: int = 48, share: float = 0.5) -> DataFrame:
    """(doc_id, raster_only): whether all of a document's pages (n_chars, raster_area, page_w, page_h) have few characters
    and images over `share` of their area."""
    bare = (F.col("n_chars") <= most) & (F.col("raster_area") >= F.greatest(F.lit(1.0), F.col("page_w") * F.col("page_h")) * share)
    return pages.groupBy("doc_id").agg(F.bool_and(bare).alias("raster_only"))


def furniture(lines: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, page, line_no): lines in the upper or lower 12 % of a page that are headers, footers or page numbers.

    body: (doc_id, body). Page numbers by their form; lines that another page has at nearly the same height, digits left
    aside, unless both pages are copies of each other; small print at the top. Null texts are none of these. A larger line that stands alone at the top
    is a title, unless its number counts pages or one of the eight pages around has the very same text.
    """
    number = F.regexp_extract("text", r"(?<![0-9])([0-9]++)[^0-9]*+\z", 1).try_cast("int")
    top, bottom = F.col("oy") < F.col("page_h") * 0.12, F.col("oy") > F.col("page_h") * 0.88
    edge = lines.filter(top | bottom).join(body, "doc_id", "left").withColumns({"norm": digits_masked("text"), "number": number, "top": F.coalesce(top, F.lit(False)), "bare": F.trim("text")})
    alone = F.count_if("top").over(Window.partitionBy(*PAGE)) == 1
    edge = edge.withColumns({"alone": alone, "ahead": F.col("number") - F.col("page"), "oy": F.col("oy").cast("double")})
    near = lambda *keys: F.expr(f"count(*) OVER (PARTITION BY {', '.join(('doc_id', 'norm', *keys))} ORDER BY oy RANGE BETWEEN {APART}D PRECEDING AND {APART}D FOLLOWING)")
    # written, as it is read five times below and its patterns run over every line
    edge = settled(edge.withColumns({"twins": near() - near("page"), "alike": near("ahead") - near("ahead", "page")}).select(*PAGE, "line_no", "norm", "bare", "top", "alone", "ahead", "oy", "size", "body", "twins", "alike"))
    # how many of these stand on copies of the page, and whether one of the pages around has the very same text: few pairs each
    copies = duplicate_pages(lines)
    copied = copies.select("doc_id", F.col("page_a").alias("page"), F.col("page_b").alias("q")).unionByName(copies.select("doc_id", F.col("page_b").alias("page"), F.col("page_a").alias("q")))
    other = edge.select("doc_id", "norm", F.col("page").alias("q"), F.col("oy").alias("q_oy"), F.col("ahead").alias("q_ahead"))
    level = F.abs(F.col("oy") - F.col("q_oy")) < 8
    on_copies = edge.join(copied, PAGE).join(other, ["doc_id", "norm", "q"]).filter(level).groupBy(*PAGE, "line_no").agg(F.count("*").alias("c_twins"), F.count_if(F.col("ahead") == F.col("q_ahead")).alias("c_alike"))
    block = F.floor(F.col("page") / 8)
    around = edge.select("doc_id", "bare", block.alias("block"), F.col("page").alias("q"), F.col("oy").alias("q_oy"))
    again = edge.withColumn("block", F.explode(F.array(block - 1, block, block + 1))).join(around, ["doc_id", "bare", "block"])
    again = again.filter((F.col("page") != F.col("q")) & (F.abs(F.col("page") - F.col("q")) <= 8) & level).join(copied, [*PAGE, "q"], "left_anti").select(*PAGE, "line_no").distinct()
    known = edge.join(on_copies, [*PAGE, "line_no"], "left").join(again.withColumn("again", F.lit(True)), [*PAGE, "line_no"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    twins, alike = F.col("twins") - none("c_twins"), F.when(F.col("ahead").isNotNull(), F.col("alike") - none("c_alike")).otherwise(0)
    known = known.withColumns({"counter": F.when(twins > 0, alike == twins), "again": F.coalesce("again", F.lit(False))})
    title = F.col("top") & F.col("alone") & (F.col("size") >= F.col("body") * 1.1) & ~F.col("counter") & ~F.col("again")
    is_number = F.col("norm").rlike(r"^[#\s\-–—/|.·()]*\z") | F.col("bare").rlike(r"^(?i)[ivxlcdm]+\z")
    repeated = F.coalesce(F.col("counter").isNotNull() & ~title, F.lit(False))
    return known.filter(is_number | repeated | (F.col("top") & (F.col("size") < F.col("body") * 0.8))).select(*PAGE, "line_no")


def good_line(text: Column, confidence: Column) -> Column:
    """A recognised line worth keeping: sure enough, with two letters or two digits, and without signs of noise."""
    return (confidence >= 60) & text.rlike(r"\p{L}.*\p{L}|\p{N}.*\p{N}") & ~text.rlike(r"[{}|<>\\]")


def good_scan_lines(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, line_no): good lines of a scan. words: (doc_id, line_no, text, confidence, x0, y0, x1, y1).

    Lines of one repeated character, thin short ones, and ones whose words fill too little of their width are noise.
    """
    sure = words.filter((F.trim("text") != "") & (F.col("confidence") >= 50))
    span = sure.groupBy("doc_id", "line_no").agg((F.max("x1") - F.min("x0")).alias("w"), F.greatest(F.lit(1.0), F.max("y1") - F.min("y0")).alias("h"), F.sum(F.greatest(F.lit(0.0), F.col("x1") - F.col("x0"))).alias("ink"))
    core = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    rows = lines.filter(good_line(F.col("text"), F.col("confidence")) & (F.col("confidence") >= 70)).withColumn("core", core).withColumn("n", F.length("core")).join(span, ["doc_id", "line_no"])
    one = (F.col("n") >= 4) & (F.replace("core", F.substring("core", 1, 1), F.lit("")) == "")
    thin = (F.col("n") <= 4) & (F.col("w") / F.col("h") < 0.45)
    filled = F.col("ink") / F.greatest(F.lit(1.0), F.col("w")) >= F.when(F.col("n") <= 4, 0.34).otherwise(0.22)
    return rows.filter(~one & ~thin & filled).select("doc_id", "line_no")


def furniture_boxes(boxes: DataFrame, labels: tuple[str, ...] = ("header", "footer"), sure: float = 0.45) -> DataFrame:
    """boxes (label, score, page_h) that a layout model takes for headers or footers, at the upper or lower fifth of a page."""
    return boxes.filter(F.col("label").isin(*labels) & (F.col("score") >= sure) & ((F.col("y1") <= F.col("page_h") * 0.2) | (F.col("y0") >= F.col("page_h") * 0.8)))


def mostly_in(figures: DataFrame, areas: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, page, box_id): figures of which an area has at least `share`."""
    both = _boxes(figures, "a_", "box_id").join(_boxes(areas, "b_"), PAGE)
    return both.filter(overlap_area("a_", "b_") >= share * box_area("a_")).select(*PAGE, F.col("a_box_id").alias("box_id")).distinct()


def raster_cover(images: DataFrame, step: int = 4) -> DataFrame:
    """(doc_id, page, hit, total): how many points of a grid (every `step`, from half a step) some image of a page covers.

    Each image is a run of points in each grid line that it meets; runs are cut where earlier ones end, so each point
    counts once and no grid is built.
    """
    half, last = step / 2, lambda size: F.ceil((F.col(size) - step / 2) / step) - 1  # noqa: E731  grid points lie below the page's size
    low, high = (lambda c: F.greatest(F.ceil((F.col(c) - half) / step), F.lit(0))), (lambda c, size: F.least(F.floor((F.col(c) - half) / step), last(size)))
    runs = images.withColumns({"a": low("x0"), "b": high("x1", "page_w"), "from": low("y0"), "to": high("y1", "page_h")}).filter("a <= b and from <= to")
    rows = runs.select(*PAGE, "a", "b", F.explode(F.sequence("from", "to")).alias("row"))
    before = F.max("b").over(Window.partitionBy(*PAGE, "row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("b") - F.greatest("a", F.coalesce(before + 1, F.col("a"))) + 1, F.lit(0))
    hit = rows.withColumn("new", new).groupBy(*PAGE).agg(F.sum("new").alias("hit"))
    total = images.groupBy(*PAGE).agg(F.max((last("page_w") + 1) * (last("page_h") + 1)).alias("total"))
    return total.join(hit, PAGE, "left").select(*PAGE, F.coalesce("hit", F.lit(0)).alias("hit"), "total")


def image_areas(boxes: DataFrame, sure: float = 0.45) -> DataFrame:
    """boxes (label, score, page_w, page_h) that are images or charts of a likely size."""
    w, h, page = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.greatest(F.lit(1.0), F.col("page_w") * F.col("page_h"))
    return boxes.filter(F.col("label").isin("image", "chart") & (F.col("score") >= sure) & (w >= 28) & (h >= 24) & (w * h).between(page * 0.006, page * 0.72))


def running_bands(images: DataFrame) -> DataFrame:
    """(doc_id, page, box_id): thin images at a page's upper or lower 12 % that two other pages have at the same height,
    to within 3 points."""
    end = F.least("y1", "page_h")
    rows = images.select(*PAGE, "box_id", "y0", "y1", end.alias("end"), "page_h")
    thin = (F.col("y1") - F.col("y0") <= F.col("page_h") * 0.1) & ((F.col("y1") <= F.col("page_h") * 0.12) | (F.col("y0") >= F.col("page_h") * 0.88))
    # what stands at one place on many pages is one row with three of these: with its own page, two others are left
    level = ["doc_id", "y0", "end"]
    nth = F.row_number().over(Window.partitionBy(*level).orderBy("page"))
    places = rows.select(*level, "page").distinct().withColumn("nth", nth).filter("nth <= 3").groupBy(*level).agg(F.collect_list("page").alias("some"))
    cell = F.floor(F.col("y0") / 3)
    mine = rows.filter(thin).select("doc_id", "y0", "y1").distinct().withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    other = places.select("doc_id", cell.alias("cell"), F.col("y0").alias("qy0"), F.col("end").alias("qend"), "some")
    met = mine.join(other, ["doc_id", "cell"]).filter((F.abs(F.col("y0") - F.col("qy0")) <= 3) & (F.abs(F.col("qend") - F.col("y1")) <= 3))
    known = met.groupBy("doc_id", "y0", "y1").agg(F.array_distinct(F.flatten(F.collect_list("some"))).alias("some"))
    return rows.filter(thin).join(known, ["doc_id", "y0", "y1"]).filter(F.size(F.array_remove("some", F.col("page"))) >= 2).select(*PAGE, "box_id")


# joins of lines and boxes


def region_cover(regions: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, box_id, cover, inside, straddle, kind): the share of a region that ink (glyph boxes by their centres)
    covers, and how many glyphs it holds or cuts; a panel if text fills it or stands whole in it, else a figure."""
    area = (F.col("r_x1") - F.col("r_x0")) * (F.col("r_y1") - F.col("r_y0"))
    both = _boxes(regions, "r_", "box_id").join(_boxes(glyphs, "g_"), PAGE, "left")
    x, y = (F.col("g_x0") + F.col("g_x1")) / 2, (F.col("g_y0") + F.col("g_y1")) / 2
    centred = (x > F.col("r_x0")) & (x < F.col("r_x1")) & (y > F.col("r_y0")) & (y < F.col("r_y1"))
    meets = (F.col("g_x1") > F.col("r_x0")) & (F.col("g_x0") < F.col("r_x1")) & (F.col("g_y1") > F.col("r_y0")) & (F.col("g_y0") < F.col("r_y1"))
    whole = (F.col("g_x0") >= F.col("r_x0") - 1) & (F.col("g_x1") <= F.col("r_x1") + 1) & (F.col("g_y0") >= F.col("r_y0") - 1) & (F.col("g_y1") <= F.col("r_y1") + 1)
    out = both.groupBy(*PAGE, F.col("r_box_id").alias("box_id"), area.alias("area")).agg(
        F.coalesce(F.sum(F.when(centred, box_area("g_"))), F.lit(0.0)).alias("ink"), F.count_if(meets & whole).alias("inside"), F.count_if(meets & ~whole).alias("straddle")
    )
    cover = F.col("ink") / F.col("area")
    kind = F.when((cover >= 0.28) | ((F.col("inside") >= 20) & (F.col("straddle") <= F.col("inside") * 0.05)), "panel").otherwise("figure")
    return out.filter("area > 0").select(*PAGE, "box_id", F.round(cover, 3).alias("cover"), "inside", "straddle", kind.alias("kind"))


def highlighted(lines: DataFrame, marks: DataFrame, share: float = 0.9) -> DataFrame:
    """(doc_id, page, line_no, touched, highlighted): lines that marks touch at their height; highlighted if one holds the
    line's middle and all of them cover `share` of its width, overlaps counted once."""
    y = F.col("oy") - F.col("size") * 0.35
    rows = lines.select(*PAGE, "line_no", F.col("x0").alias("l0"), F.col("x1").alias("l1"), y.alias("y"), ((F.col("x0") + F.col("x1")) / 2).alias("x"))
    both = rows.join(_boxes(marks, "m_", "box_id"), PAGE).filter((F.col("y") > F.col("m_y0") - 1) & (F.col("y") < F.col("m_y1") + 1))
    held = (F.col("x") > F.col("m_x0") - 1) & (F.col("x") < F.col("m_x1") + 1)
    band = (F.col("m_x1") > F.col("l0")) & (F.col("m_x0") < F.col("l1"))
    a, b = F.greatest("l0", "m_x0"), F.least("l1", "m_x1")
    before = F.max(F.when(band, b)).over(Window.partitionBy(*PAGE, "line_no").orderBy("m_x0", "m_box_id").rowsBetween(Window.unboundedPreceding, -1))
    part = F.when(band, F.greatest(F.lit(0.0), b - F.greatest(a, F.coalesce(before, a)))).otherwise(0.0)
    cut = both.withColumns({"part": part, "held": held, "band": band})
    out = cut.groupBy(*PAGE, "line_no", "l0", "l1").agg(F.sum("part").alias("covered"), F.bool_or("held").alias("held"), F.bool_or("band").alias("touched"))
    return out.select(*PAGE, "line_no", "touched", (F.col("held") & (F.col("covered") >= (F.col("l1") - F.col("l0")) * share)).alias("highlighted"))


def wraps(lines: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, wrap_left, wrap_right): the figure (the last by id) that a line stops at or starts behind."""
    y = F.col("oy") - F.col("size") * 0.35
    both = lines.select(*PAGE, "line_no", "x0", "x1", "size", y.alias("y")).join(_boxes(figures, "f_", "box_id"), PAGE)
    both = both.filter((F.col("y") >= F.col("f_y0") - F.col("size")) & (F.col("y") <= F.col("f_y1") + F.col("size")))
    right = (F.col("x1") <= F.col("f_x1")) & (F.col("x1") >= F.col("f_x0") - F.col("size") * 2) & (F.col("x0") < F.col("f_x0"))
    left = (F.col("x0") >= F.col("f_x0")) & (F.col("x0") <= F.col("f_x1") + F.col("size") * 2) & (F.col("x1") > F.col("f_x1"))
    out = both.groupBy(*PAGE, "line_no").agg(F.max(F.when(left, F.col("f_box_id"))).alias("wrap_left"), F.max(F.when(right, F.col("f_box_id"))).alias("wrap_right"))
    return out.filter("wrap_left is not null or wrap_right is not null")


def words_to_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, page, word, cell): the first cell that holds a word's centre, else the cell whose centre is nearest.

    words: (doc_id, page, word, cx, cy); a page without cells keeps no words."""
    inside = F.col("cx").between(F.col("c_x0"), F.col("c_x1")) & F.col("cy").between(F.col("c_y0"), F.col("c_y1"))
    dx, dy = F.col("cx") - (F.col("c_x0") + F.col("c_x1")) / 2, F.col("cy") - (F.col("c_y0") + F.col("c_y1")) / 2
    both = words.join(_boxes(cells, "c_", "box_id"), PAGE).withColumns({"in": inside, "far": dx * dx + dy * dy})
    best = F.coalesce(F.min(F.when(F.col("in"), F.col("c_box_id"))), F.min_by("c_box_id", F.struct("far", "c_box_id")))
    return both.groupBy(*PAGE, "word").agg(best.alias("cell"))


def without_overlaps(boxes: DataFrame, first: DataFrame, share: float = 0.3) -> DataFrame:
    """boxes that share at most `share` of the smaller area with any of `first` on their page."""
    a, b = boxes.select("*", *(F.col(c).alias("a_" + c) for c in ("x0", "y0", "x1", "y1"))), _boxes(first, "b_").withColumnsRenamed({"doc_id": "b_doc", "page": "b_page"})
    met = overlap_area("a_", "b_") > share * F.least(box_area("a_"), box_area("b_"))
    return a.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("page") == F.col("b_page")) & met, "left_anti").drop("a_x0", "a_y0", "a_x1", "a_y1")


def in_page_order(parts: DataFrame, others: DataFrame) -> DataFrame:
    """(doc_id, place, page, y, source, item) of two kinds of parts (doc_id, page, y, item), from 1 in each document: by page
    and height; at the same height the parts come first."""
    both = parts.select(*PAGE, "y", F.lit(0).alias("source"), "item").unionByName(others.select(*PAGE, "y", F.lit(1).alias("source"), "item"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "source", "item")))


def style_chains(styles: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, style, bold, size): each style (doc_id, style, based_on, bold, size) with what it leaves open taken from the
    styles that it is based on, the nearest first, `most` styles in all; circles are walked as far, too.

    Chains of 1, 2, 4 and so on styles are made of two of the last ones each, and those that `most` is the sum of are put
    one behind another: some 2 log2(most) joins, each of written tables.
    """
    def behind(chain: DataFrame, next_: DataFrame) -> DataFrame:
        then = next_.select(F.col("doc_id").alias("_doc"), *(F.col(c).alias("_" + c) for c in ("style", "based_on", "bold", "size")))
        met = chain.join(then, (F.col("doc_id") == F.col("_doc")) & (F.col("based_on") == F.col("_style")), "left")
        return settled(met.select("doc_id", "style", F.col("_based_on").alias("based_on"), F.coalesce("bold", "_bold").alias("bold"), F.coalesce("size", "_size").alias("size")), "styles")

    power, out, left = settled(styles.select("doc_id", "style", "based_on", "bold", "size"), "styles"), None, most
    while left:
        if left & 1:
            out = power if out is None else behind(out, power)
        left >>= 1
        if left:
            power = behind(power, power)
    return out.select("doc_id", "style", "bold", "size")


# aggregates


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the median size of a document's characters; lines without characters don't count."""
    w = Window.partitionBy("doc_id").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = lines.filter(F.length("text") > 0).groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("k"))
    summed = sizes.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("doc_id")))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("size")))
    return summed.groupBy("doc_id").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("body"))


def paragraph_style(seams: DataFrame, indent: str, gap: str) -> DataFrame:
    """(doc_id, style): whether a document sets paragraphs apart by indents or by gaps, from its seams' reasons."""
    n = seams.groupBy("doc_id").agg(F.count_if(F.col("reason") == indent).alias("i"), F.count_if(F.col("reason") == gap).alias("g"))
    return n.select("doc_id", F.when((F.col("i") >= 2) & (F.col("i") > F.col("g") * 2), "indent").when(F.col("g") >= 2, "gap").otherwise("unknown").alias("style"))


def document_stats(lines: DataFrame, seams: DataFrame) -> DataFrame:
    """(doc_id, pages, lines, body, chars, rotated, flagged, bold_chars): one row of figures for each document."""
    chars = F.length(F.regexp_replace("text", r"\s", ""))
    mine = lines.groupBy("doc_id").agg(
        F.count_distinct("page").alias("pages"), F.count("*").alias("lines"), F.sum(chars).alias("chars"), F.count_if(~is_upright(F.col("angle"))).alias("rotated"), F.sum(F.when(F.col("weight") >= 600, chars).otherwise(0)).alias("bold_chars")
    )
    flagged = seams.groupBy("doc_id").agg(F.count_if("flagged").alias("flagged"))
    return mine.join(body_size(lines), "doc_id", "left").join(flagged, "doc_id", "left").select("doc_id", "pages", "lines", F.round("body", 2).alias("body"), "chars", "rotated", F.coalesce("flagged", F.lit(0)).alias("flagged"), "bold_chars")


def main_colours(runs: DataFrame, key: list[str]) -> DataFrame:
    """(key, colour): the colour (an array of r, g, b) of most characters; of equals the one that comes first.

    runs: key, pos, n (characters), colour."""
    counted = runs.groupBy(*key, "colour").agg(F.sum("n").alias("n"), F.min("pos").alias("first"))
    return counted.groupBy(*key).agg(F.max_by("colour", F.struct("n", -F.col("first"))).alias("colour"))


def colour_distance(a: Column, b: Column) -> Column:
    return sum((F.abs(F.get(a, i) - F.get(b, i)) for i in range(1, 3)), F.abs(F.get(a, 0) - F.get(b, 0)))


def styled_paragraphs(runs: DataFrame, far: float = 90, share: float = 0.3) -> DataFrame:
    """(doc_id, para, coloured, styled): paragraphs whose main colour is not the document's, and those of whose characters
    `share` or more are coloured, bold or italic. runs: doc_id, para, pos, n, colour, weight, italic."""
    body = main_colours(runs, ["doc_id"]).withColumnRenamed("colour", "body")
    own = main_colours(runs, ["doc_id", "para"]).withColumnRenamed("colour", "own")
    odd = (colour_distance(F.col("colour"), F.col("body")) > far) | (F.col("weight") >= 600) | F.col("italic")
    shares = runs.join(body, "doc_id").groupBy("doc_id", "para", "body").agg(F.sum("n").alias("all"), F.sum(F.when(odd, F.col("n")).otherwise(0)).alias("odd"))
    both = shares.join(own, ["doc_id", "para"])
    return both.select("doc_id", "para", (colour_distance(F.col("own"), F.col("body")) > far).alias("coloured"), ((F.col("all") > 0) & (F.col("odd") >= F.col("all") * share)).alias("styled"))


def otsu_thresholds(levels: DataFrame, low: int = 115, high: int = 195, usual: int = 170) -> DataFrame:
    """(doc_id, threshold): the grey level that parts a page's pixels (doc_id, level, n) best into two classes, the first of
    equals, kept between low and high."""
    w = Window.partitionBy("doc_id").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("doc_id")
    summed = levels.groupBy("doc_id", "level").agg(F.sum("n").cast("double").alias("n")).withColumns({"w0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("level")).over(w), "all": F.sum("n").over(whole), "sum": F.sum(F.col("n") * F.col("level")).over(whole)})
    w1 = F.col("all") - F.col("w0")
    apart = F.col("s0") / F.col("w0") - (F.col("sum") - F.col("s0")) / w1
    between = F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") * w1 * apart * apart)
    best = summed.withColumn("between", between).groupBy("doc_id").agg(F.max_by("level", F.struct("between", -F.col("level"))).alias("level"), F.max("between").alias("b"))
    return best.select("doc_id", F.greatest(F.lit(low), F.least(F.lit(high), F.when(F.col("b").isNull(), usual).otherwise(F.col("level")))).alias("threshold"))


def paragraph_layout(lines: DataFrame) -> DataFrame:
    """(doc_id, para, page, x0, y0, x1, y1, align, indent, size, pitch, breaks): how paragraphs are set.

    lines: doc_id, para, page, line_no, x0, x1, oy, size and their column's `left` and `right`. Shares of lines that reach
    the edges leave out the last line.
    """
    w = Window.partitionBy("doc_id", "para").orderBy("line_no")
    size = F.median("size").over(Window.partitionBy("doc_id", "para"))
    rows = lines.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("doc_id", "para")), "mid": size, "step": F.col("oy") - F.lag("oy").over(w)})
    tol, body = F.col("mid") * 0.3, (F.col("i") < F.col("n")) | (F.col("n") == 1)
    left_ok = (F.abs(F.col("x0") - F.col("left")) < tol) | ((F.col("i") == 1) & (F.col("x0") > F.col("left")))
    right_ok = F.abs(F.col("x1") - F.col("right")) < tol
    centred = (F.abs((F.col("x0") - F.col("left")) - (F.col("right") - F.col("x1"))) < tol) & (F.col("x0") - F.col("left") > F.col("mid"))
    first = lambda c: F.min_by(c, "line_no")
    out = rows.groupBy("doc_id", "para", "mid", "n").agg(
        first("page").alias("page"), F.min("x0").alias("x0"), F.min(F.col("oy") - F.col("size")).alias("y0"), F.max("x1").alias("x1"), F.max("oy").alias("y1"), F.bool_and(centred).alias("c"),
        F.avg(F.when(body, left_ok.cast("int"))).alias("l"), F.avg(F.when(body, right_ok.cast("int"))).alias("r"), first(F.col("x0") - F.col("left")).alias("indent"), F.median(F.when(F.col("step") > 0, F.col("step"))).alias("pitch"),
    )
    align = F.when(F.col("c"), "center").when((F.col("r") > 0.8) & (F.col("l") > 0.8) & (F.col("n") > 1), "justify").when((F.col("r") > 0.8) & (F.col("l") < 0.5), "right").otherwise("left")
    return out.select("doc_id", "para", "page", "x0", "y0", "x1", "y1", align.alias("align"), F.round("indent", 2).alias("indent"), F.round("mid", 2).alias("size"), F.round("pitch", 2).alias("pitch"), (F.col("n") - 1).alias("breaks"))


def page_breaks(lines: DataFrame, boxes: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, page, bottom): pages that end on purpose: nothing on them reaches below `share` of their height."""
    both = lines.select(*PAGE, (F.col("oy") + F.col("size") * 0.3).alias("low"), "page_h").unionByName(boxes.select(*PAGE, F.col("y1").alias("low"), "page_h"))
    return both.groupBy(*PAGE).agg(F.max("low").alias("bottom"), F.max("page_h").alias("h")).filter(F.col("bottom") < F.col("h") * share).select(*PAGE, "bottom")


def upright_angles(paras: DataFrame) -> DataFrame:
    """(doc_id, page, deg): the angle at which most of a page's characters are read; of equals the one nearest to 0, then
    the smaller one. paras: doc_id, page, deg, text."""
    weights = paras.groupBy(*PAGE, "deg").agg(F.sum(F.length("text")).alias("n"))
    return weights.groupBy(*PAGE).agg(F.max_by("deg", F.struct("n", -F.abs(F.col("deg")), -F.col("deg"))).alias("deg"))


def best_angles(tries: DataFrame) -> DataFrame:
    """(doc_id, page, deg, score): of the angles tried at a region, the one whose lines (deg, text, confidence) are read with
    the highest sum of confidence by characters; of equals the smallest turn."""
    score = F.sum(F.col("confidence") * F.length(F.regexp_replace("text", r"\s", "")))
    tried = tries.groupBy(*PAGE, "deg").agg(score.alias("score"))
    return tried.groupBy(*PAGE).agg(F.max_by("deg", F.struct("score", -F.abs(F.col("deg")), -F.col("deg"))).alias("deg"), F.max("score").alias("score"))


def suspect_gaps(gaps: DataFrame) -> DataFrame:
    """(doc_id, line_no, at): gaps (doc_id, line_no, at, gap, is_space, size, tracking) so much wider than the line's other
    spaces that a character may be missing: over 1.8 sizes and 2.5 times the median of at least two others."""
    spaces = gaps.filter("is_space").groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list("gap")).alias("all"))
    own = F.when(F.col("is_space"), F.array_position("all", F.col("gap"))).otherwise(F.lit(0))
    others = F.when(own > 0, F.concat(F.slice("all", 1, F.greatest(own - 1, F.lit(0)).cast("int")), F.slice("all", (own + 1).cast("int"), F.size("all")))).otherwise(F.col("all"))
    m = F.size("others")
    middle = (F.get("others", F.floor((m - 1) / 2).cast("int")) + F.get("others", F.floor(m / 2).cast("int"))) / 2
    wide = gaps.filter(F.col("gap") - F.col("tracking") > F.col("size") * 1.8).join(spaces, ["doc_id", "line_no"]).withColumn("others", others)
    return wide.filter((m >= 2) & (F.col("gap") > middle * 2.5)).select("doc_id", "line_no", "at")


def column_edges(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, col, centre, x0, x1): a table's columns: the upper median of the centres of their cells of one column,
    evenly spread where there is none, and edges half-way between neighbours. cells: doc_id, page, col, colspan, x0, x1;
    tables: doc_id, page, x0, x1, n_cols."""
    one = cells.filter("colspan = 1").select(*PAGE, "col", ((F.col("x0") + F.col("x1")) / 2).alias("c"))
    centres = at_ranks(one, [*PAGE, "col"], "c", centre=lambda n: F.floor(n / 2)).drop("n")
    every = tables.select(*PAGE, F.col("x0").alias("t0"), F.col("x1").alias("t1"), "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    placed = every.join(centres, [*PAGE, "col"], "left").withColumn("centre", F.coalesce("centre", F.col("t0") + (F.col("col") + 0.5) * (F.col("t1") - F.col("t0")) / F.col("n_cols")))
    w = Window.partitionBy(*PAGE).orderBy("col")
    edges = {"a": F.coalesce((F.lag("centre").over(w) + F.col("centre")) / 2, F.col("t0")), "b": F.coalesce((F.lead("centre").over(w) + F.col("centre")) / 2, F.col("t1"))}
    return placed.withColumns(edges).select(*PAGE, "col", "centre", F.col("a").alias("x0"), F.col("b").alias("x1"))


def row_heights(cells: DataFrame, least: float = 14.0) -> DataFrame:
    """(doc_id, page, row, height): the upper median of the heights of a row's cells of one row, `least` at least."""
    one = cells.filter("rowspan = 1 and y1 > y0").select(*PAGE, "row", (F.col("y1") - F.col("y0")).alias("h"))
    return at_ranks(one, [*PAGE, "row"], "h", h=lambda n: F.floor(n / 2)).select(*PAGE, "row", F.greatest(F.lit(least), F.col("h")).alias("height"))


def cell_aligns(cells: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, box_id, free, align): the height that a cell's ink leaves free, and whether it stands at the top, the
    middle or the bottom. glyphs: doc_id, page, box_id (their cell), y0, y1."""
    ink = glyphs.groupBy(*PAGE, "box_id").agg(F.min("y0").alias("g0"), F.max("y1").alias("g1"))
    rows = cells.join(ink, [*PAGE, "box_id"], "left")
    free = (F.col("y1") - F.col("y0")) - (F.col("g1") - F.col("g0"))
    at = (F.col("g0") - F.col("y0")) / free
    align = F.when(free.isNull() | (free < 4), "middle").when(at < 0.3, "top").when(at > 0.7, "bottom").otherwise("middle")
    return rows.select(*PAGE, "box_id", F.greatest(F.lit(0.0), F.coalesce(free, F.lit(0.0))).alias("free"), align.alias("align"))


# windows


def local_pitch(lines: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, line_no, pitch): the distance of lines to expect at each line after its document's first: the column's pitch
    (by the size for larger or smaller text), or the smaller of the steps before and after it if that is larger."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.select("doc_id", "page", "line_no", "oy", "size", F.col("pitch").alias("usual")).join(body, "doc_id")
    around = {f"{c}{s}": F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w) for c in ("oy", "size", "page") for s, k in (("_p", 1), ("_pp", 2), ("_n", -1))}
    r = rows.withColumns(around).filter("oy_p is not null")
    same = F.abs(F.col("size_p") - F.col("size")) < 0.5
    base = F.when(same & (F.abs(F.col("size") - F.col("body")) > F.col("body") * 0.12), F.col("usual") * F.col("size") / F.col("body")).otherwise(F.col("usual"))
    step = lambda a, b: F.when((F.col(f"page{a}") == F.col(f"page{b}")) & (F.abs(F.col(f"size{a}") - F.col(f"size{b}")) < 0.5) & (F.col(f"oy{b}") > F.col(f"oy{a}")), F.col(f"oy{b}") - F.col(f"oy{a}"))
    beside = F.least(step("_pp", "_p"), step("", "_n"))
    return r.select("doc_id", "line_no", F.coalesce(F.greatest(base, beside), base).alias("pitch"))


def leader_runs(glyphs: DataFrame, sign: str = "�") -> DataFrame:
    """(doc_id, line_no, ci): unreadable glyphs that are dot leaders: runs of three or more (two before a number that ends
    the line) of narrow ones in even steps. glyphs: doc_id, line_no, ci, c, x0, x1, size, font, as rows, or a line's as one array (glyphs)."""
    lines = gathered(glyphs, "c", "x0", "x1", "size", "font")
    of = lambda c, t: F.col(f"glyphs.{c}").cast(f"array<{t}>").alias(c)
    rows = lines.select("doc_id", "line_no", F.col("glyphs.ci").alias("ci"), of("c", "string"), of("font", "string"), *(of(c, "double") for c in ("x0", "x1", "size")))
    full = StructType([rows.schema["doc_id"], rows.schema["line_no"], StructField("ci", rows.schema["ci"].dataType.elementType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(full)
        for batch in batches:
            at, k = _leaders(batch, sign)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).flatten().take(k).cast(target.field(2).type)], schema=target)

    return rows.mapInArrow(run, full)


def _leaders(batch: pa.RecordBatch, sign: str) -> tuple[pa.Array, pa.Array]:
    """(line, glyph) of the dots of leaders, by their places in the batch and among all its glyphs; all lines at once."""
    n = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    line = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    c, font = batch.column(3).flatten(), batch.column(4).flatten()
    x0, x1, size = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (5, 6, 7))
    known = pc.is_valid(c).to_numpy(zero_copy_only=False)
    of = lambda values: pc.is_in(c, pa.array(values)).to_numpy(zero_copy_only=False)
    # the last glyph that is no digit, and the last one
    last = []
    for those in (known & ~of(list("0123456789")), known):
        last.append(np.full(len(n), -1))
        last[-1][line[those]] = place[those]
    dots = np.flatnonzero(of([sign]) & (x1 - x0 <= size * 0.45))
    if not len(dots):
        return pa.array([], pa.int64()), pa.array([], pa.int64())
    kind = pc.fill_null(pc.dictionary_encode(font).indices, -1).to_numpy(zero_copy_only=False)[dots]
    goes_on = np.concatenate([[False], (np.diff(dots) == 1) & (line[dots[1:]] == line[dots[:-1]]) & (kind[1:] == kind[:-1]) & (kind[1:] >= 0)])
    first = np.flatnonzero(~goes_on)
    long = np.diff(first, append=len(dots))
    step = np.where(goes_on, np.diff(x0[dots], prepend=np.nan), np.nan)
    end, of_line = place[dots[first + long - 1]], line[dots[first]]
    even = np.fmax.reduceat(step, first) - np.fmin.reduceat(step, first) <= size[dots[first]] * 0.3
    good = ((long >= 3) | ((long == 2) & (end >= last[0][of_line]) & (end < last[1][of_line]))) & even
    found = dots[np.repeat(good, long)]
    return pa.array(line[found]), pa.array(found)


def spaced_cuts(values: DataFrame, apart: float = 3.0) -> DataFrame:
    """(doc_id, page, x): distinct rounded places, of which one stays if it is more than `apart` from the one before it,
    kept or not."""
    rounded = values.select(*PAGE, half_up(F.col("x")).alias("x")).distinct()
    before = F.lag("x").over(Window.partitionBy(*PAGE).orderBy("x"))
    return rounded.withColumn("before", before).filter("before is null or x - before > %s" % apart).drop("before")


def read_paragraphs(rows: DataFrame) -> DataFrame:
    """rows (doc_id, page, line_no, x0, y0, x1, y1) of recognised lines with par: lines from top to bottom, a new paragraph at
    a wide gap, little overlap in x, or a jump of the left edge."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_no")
    p = lambda c: F.lag(c).over(w)
    height = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    r = rows.withColumns({f"p_{c}": p(c) for c in ("x0", "y0", "x1", "y1")}).withColumn("h", F.greatest(height, F.greatest(F.lit(1.0), F.col("p_y1") - F.col("p_y0"))))
    shared = F.greatest(F.lit(0.0), F.least("x1", "p_x1") - F.greatest("x0", "p_x0")) / F.greatest(F.lit(1.0), F.least(F.col("x1") - F.col("x0"), F.col("p_x1") - F.col("p_x0")))
    new = F.col("p_x0").isNull() | (F.col("y0") - F.col("p_y1") > F.col("h") * 1.25) | (shared < 0.35) | (F.abs(F.col("x0") - F.col("p_x0")) > F.col("h") * 2.5)
    return r.withColumn("new", new.cast("int")).withColumn("par", F.sum("new").over(w) - 1).drop("p_x0", "p_y0", "p_x1", "p_y1", "h", "new")


def gaps_between_regions(paras: DataFrame, most: int = 3) -> DataFrame:
    """paras (doc_id, page, col, y0, y1, lh, pitch) with blanks: empty lines above, by the distance from the paragraph before
    it in its column, in pitches (1.6 line heights where the pitch is unknown, none where those are 0); 0.75 or more counts."""
    w = Window.partitionBy(*PAGE, "col").orderBy("y0")
    lh, pitch = F.greatest(F.col("lh"), F.lag("lh").over(w)), F.greatest(F.coalesce("pitch", F.lit(0.0)), F.coalesce(F.lag("pitch").over(w), F.lit(0.0)))
    r = paras.withColumns({"_before": F.lag("y1").over(w), "_lh": lh, "_pitch": pitch})
    each = F.when(F.col("_pitch") > 0, F.col("_pitch")).otherwise(F.col("_lh") * 1.6)
    extra = F.try_divide(F.col("y0") - F.col("_before") - F.greatest(F.lit(0.0), each - F.col("_lh")), each)
    return r.withColumn("blanks", F.coalesce(F.when(extra >= 0.75, F.least(half_up(extra), F.lit(most))), F.lit(0)).cast("int")).drop("_before", "_lh", "_pitch")


# scans, columns beside columns, tables as HTML


def scan_pages(pages: DataFrame, most: int = 48, share: float = 0.9) -> DataFrame:
    """(doc_id, page, is_scan): pages (n_chars, n_areas, hit, total) to be read from their image: those with image areas and no
    characters, and in documents that are scans by half of their pages, those with few characters that images cover."""
    bare = (F.col("n_chars") <= most) & (F.col("hit") >= F.col("total") * share)
    whole = pages.groupBy("doc_id").agg((F.count_if(bare) >= F.count("*") * 0.5).alias("scans"))
    scan = (F.col("n_areas") > 0) & ((F.col("n_chars") == 0) | (bare & F.col("scans")))
    return pages.join(whole, "doc_id").select(*PAGE, scan.alias("is_scan"))


def side_notes(segments: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, host): segments (panel, col, oy, x0, x1, size) of narrow columns that belong to the rows of the
    column on their left: no wider than five characters, and three of them and 60 % on the height of a row there; the host is
    that row, the first of several. Columns with two panels count by panel as their rows do."""
    col = Window.partitionBy(*PAGE, "col")
    r = segments.withColumns({"usual": F.median("size").over(col), "n": F.count("*").over(col), "wide": F.max(F.col("x1") - F.col("x0")).over(col)})
    mine = r.filter("wide <= usual * 5").select(*PAGE, "line_no", "panel", "oy", "usual", "n", "col", (F.col("col") - 1).alias("left_col"))
    other = segments.select(*PAGE, "panel", F.col("col").alias("left_col"), F.col("line_no").alias("o_line"), F.col("oy").alias("o_oy"))
    met = mine.join(other, [*PAGE, "panel", "left_col"]).filter(F.abs(F.col("o_oy") - F.col("oy")) < F.col("usual") * 0.35)
    hosts = met.groupBy(*PAGE, "line_no", "col", "n").agg(F.min("o_line").alias("host"))
    k = F.count("*").over(col)
    return hosts.withColumn("k", k).filter("k >= 3 and k >= n * 0.6").select(*PAGE, "line_no", "host")


def table_html(cells: DataFrame) -> DataFrame:
    """(doc_id, page, html): tables of placed cells (row, col, colspan, rowspan, align, text) as HTML, empty cells with a break."""
    attribute = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), F.col(name), F.lit('"'))).otherwise("")
    style = F.when(F.col("align").isin("center", "right"), F.concat(F.lit(' style="text-align:'), "align", F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<td"), attribute("colspan"), attribute("rowspan"), style, F.lit(">"), F.when(F.col("text") == "", "<br>").otherwise(escaped("text", quotes=False)), F.lit("</td>"))
    rows = cells.groupBy(*PAGE, "row").agg(F.array_sort(F.collect_list(F.struct("col", cell.alias("td")))).alias("tds"))
    line = F.concat(F.lit("<tr>"), F.array_join(F.transform("tds", lambda t: t["td"]), ""), F.lit("</tr>"))
    tables = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("row", line.alias("tr")))).alias("trs"))
    return tables.select(*PAGE, F.concat(F.lit("<table>"), F.array_join(F.transform("trs", lambda t: t["tr"]), ""), F.lit("</table>")).alias("html"))


def column_order(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, col, place): recognised lines (text, x0, y0, x1, y1) in reading order, from 1: lines over columns that
    stand above them, the columns from left to right, then the other lines over columns; col is null for those.

    Columns are parted by upright strips of 1.5 characters that hardly any narrow line reaches; pages of fewer than four
    lines stay as they are. What narrow lines cover is counted point by point, so no pairs of lines are compared.
    """
    whole = Window.partitionBy(*PAGE)
    chars = F.greatest(F.lit(1), F.length(F.regexp_replace("text", r"\s", "")))
    r = lines.withColumns({"n": F.count("*").over(whole), "low": F.min("x0").over(whole), "wide": F.max("x1").over(whole) - F.min("x0").over(whole), "char": F.median((F.col("x1") - F.col("x0")) / chars).over(whole)})
    narrow = r.filter((F.col("n") >= 4) & (F.col("x1") - F.col("x0") < F.col("wide") * 0.62)).withColumn("k", F.count("*").over(whole))
    # what begins and ends at each place: between two places all points are covered alike, and a strip reaches from the end of a covered
    # stretch to the next one; where characters have no width, each point of a stretch ends an empty strip, too
    begin, end = F.floor(F.col("x0") - F.col("low")), F.ceil(F.col("x1") - F.col("low")) + 1
    turns = narrow.select(*PAGE, "low", "char", "k", F.explode(F.array(F.struct(begin.alias("x"), F.lit(1).alias("d")), F.struct(end.alias("x"), F.lit(-1).alias("d")))).alias("t"))
    steps = turns.groupBy(*PAGE, "low", "char", "k", "t.x").agg(F.sum("t.d").alias("d"))
    along = Window.partitionBy(*PAGE).orderBy("x")
    spans = steps.withColumns({"c": F.sum("d").over(along), "z": F.lead("x").over(along) - 1}).filter(F.col("c") >= F.greatest(F.lit(1), half_up(F.col("k") * 0.08)))
    inner = F.when((F.col("char") <= 0) & (F.col("z") > F.col("x")), F.transform(F.sequence(F.col("x") + 1, F.col("z")), lambda x: F.struct((x - 1).alias("before"), x.alias("x"))))
    ends = spans.withColumn("before", F.lag("z").over(along)).select(*PAGE, "low", "char", "k", F.explode(F.concat(F.array(F.struct("before", "x")), F.coalesce(inner, F.array().cast("array<struct<before:bigint,x:bigint>>")))).alias("p"))
    strips = ends.select(*PAGE, "low", "char", "k", "p.before", "p.x").filter((F.col("k") >= 4) & (F.col("x") - F.col("before") - 1 >= F.col("char") * 1.5))
    gutters = strips.select(*PAGE, (F.col("low") + F.col("before") + 1).alias("g0"), (F.col("low") + F.col("x")).alias("g1"))
    over, behind = (F.col("x0") < F.col("g0")) & (F.col("x1") > F.col("g1")), (F.col("x0") + F.col("x1")) / 2 > F.col("g0")
    placed = r.join(gutters, PAGE, "left").groupBy(*PAGE, "line_no", "n", "x0", "y0", "y1").agg(F.coalesce(F.bool_or(over), F.lit(False)).alias("over"), F.count_if(behind).alias("col"))
    top = F.min(F.when(~F.col("over"), F.col("y0"))).over(whole)
    part = F.when(~F.col("over"), 1).when(top.isNull() | (F.col("y1") <= top + 1), 0).otherwise(2)
    few = F.col("n") < 4
    keys = placed.withColumns({"col": F.when(~F.col("over"), F.col("col")), "part": F.when(few, 0).otherwise(part)}).withColumn("high", F.when(few, 0.0).when(F.col("part") == 1, F.col("y1")).otherwise(F.col("y0")))
    order = Window.partitionBy(*PAGE).orderBy("part", F.when(F.col("part") == 1, F.col("col")), "high", F.when(F.col("part") == 1, F.col("x0")), "line_no")
    return keys.select(*PAGE, "line_no", "col", F.row_number().over(order).alias("place"))


def image_text_areas(images: DataFrame, pages: DataFrame, most: int = 48) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1, n): where a page's images may hold text: images of a size for it (px_w, px_h too), those that
    meet as one; the whole page where it has few characters and images over half of it, or one over 45 %. pages: n_chars,
    page_w, page_h."""
    at = {"x0": F.greatest(F.lit(0.0), "x0"), "y0": F.greatest(F.lit(0.0), "y0"), "x1": F.least("page_w", "x1"), "y1": F.least("page_h", "y1")}
    rows = images.join(pages.select(*PAGE, "n_chars", "page_w", "page_h"), PAGE).withColumns(at)
    w, h, page = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("page_w") * F.col("page_h")
    some = rows.filter((w >= 40) & (h >= 20) & (w * h >= page * 0.01) & (F.col("px_w") >= 80) & (F.col("px_h") >= 30))
    sizes = some.groupBy(*PAGE, "n_chars", "page_w", "page_h").agg(F.sum(w * h).alias("all"), F.max(w * h).alias("largest"))
    scans = sizes.filter((F.col("n_chars") <= most) & ((F.col("all") >= page * 0.5) | (F.col("largest") >= page * 0.45)))
    names = (*PAGE, "box_id", "x0", "y0", "x1", "y1")
    full = scans.select(*PAGE, F.lit(-1).alias("box_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("page_w").alias("x1"), F.col("page_h").alias("y1"))
    return grown_boxes(some.join(scans.select(*PAGE), PAGE, "left_anti").select(*names).unionByName(full))
