"""Boxes and edges: spatial, as-of and range joins, all behind an equality on document and page; column measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import box_area, half_up, let, nearest_rank, overlap_area
from quire.operators.lines import gathered
from quire.operators.ranks import at_ranks

BOX = ("x0", "y0", "x1", "y1")


def line_boxes(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, x0, y0, x1, y1, oy, size): lines on pages of 50, 6 points a character, 12 a line."""
    at = (F.col("line_no") % 50 + 1) * 12.0
    return lines.select("doc_id", F.floor(F.col("line_no") / 50).cast("int").alias("page"), "line_no", "text", F.lit(0.0).alias("x0"), (at - 10.0).alias("y0"), (F.length("text") * 6.0).alias("x1"), (at + 2.0).alias("y1"), at.alias("oy"), F.lit(10.0).alias("size"))


def _prefixed(df: DataFrame, p: str, *more: str) -> DataFrame:
    return df.select("doc_id", "page", *(F.col(c).alias(p + c) for c in (*BOX, *more)))


def first_box_of(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """points (doc_id, page, key, x, y) with box_id: the first box (by id) whose inside holds the point, or -1."""
    inside = (F.col("x") > F.col("b_x0")) & (F.col("x") < F.col("b_x1")) & (F.col("y") > F.col("b_y0")) & (F.col("y") < F.col("b_y1"))
    found = points.join(_prefixed(boxes, "b_", "box_id"), ["doc_id", "page"]).filter(inside).groupBy("doc_id", "page", key).agg(F.min("b_box_id").alias("box_id"))
    return points.join(found, ["doc_id", "page", key], "left").withColumn("box_id", F.coalesce("box_id", F.lit(-1)))


def covered_boxes(boxes: DataFrame, share: float = 0.85) -> DataFrame:
    """boxes (doc_id, page, box_id, seq) of which a box drawn later on the same page covers at least `share`."""
    pairs = _prefixed(boxes, "a_", "box_id", "seq").join(_prefixed(boxes, "b_", "seq"), ["doc_id", "page"])
    return pairs.filter((F.col("b_seq") > F.col("a_seq")) & (overlap_area("a_", "b_") >= share * box_area("a_"))).select("doc_id", "page", F.col("a_box_id").alias("box_id")).distinct()


def mostly_inside(parts: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page, part, box_id): parts with more than half of their points (doc_id, page, part, x, y) inside a box."""
    inside = F.col("x").between(F.col("b_x0"), F.col("b_x1")) & F.col("y").between(F.col("b_y0"), F.col("b_y1"))
    size = parts.groupBy("doc_id", "page", "part").agg(F.count("*").alias("n"))
    hits = parts.join(_prefixed(boxes, "b_", "box_id"), ["doc_id", "page"]).filter(inside).groupBy("doc_id", "page", "part", F.col("b_box_id").alias("box_id")).agg(F.count("*").alias("hit"))
    return hits.join(size, ["doc_id", "page", "part"]).filter(F.col("hit") * 2 > F.col("n")).select("doc_id", "page", "part", "box_id")


def following_line(figures: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, box_id, before_line): the first line of the page that begins below a figure's top and meets it in x; else the
    line after the page's last one; on a page without lines, the first line of a later page, or the end of the document.
    A document without lines has null."""
    over = (F.col("oy") - F.col("size") > F.col("b_y0")) & (F.col("x0") < F.col("b_x1")) & (F.col("x1") > F.col("b_x0"))
    boxes = _prefixed(figures, "b_", "box_id")
    direct = boxes.join(lines, ["doc_id", "page"]).filter(over).groupBy("doc_id", F.col("b_box_id").alias("box_id")).agg(F.min("line_no").alias("direct"))
    pages = lines.groupBy("doc_id", "page").agg(F.min("line_no").alias("first"), (F.max("line_no") + 1).alias("after"))
    ends = pages.groupBy("doc_id").agg(F.max("after").alias("end"))
    # each figure's page and the pages with lines in one order: the next page with lines is the next first line
    asked = figures.select("doc_id", "page").distinct().join(pages, ["doc_id", "page"], "full_outer")
    later = Window.partitionBy("doc_id").orderBy("page").rowsBetween(1, Window.unboundedFollowing)
    known = asked.withColumn("next", F.first("first", ignorenulls=True).over(later))
    out = figures.select("doc_id", "page", "box_id").join(direct, ["doc_id", "box_id"], "left").join(known, ["doc_id", "page"], "left").join(ends, "doc_id", "left")
    return out.select("doc_id", "box_id", F.coalesce("direct", "after", "next", "end").alias("before_line"))


def nearest_left(cells: DataFrame, hosts: DataFrame) -> DataFrame:
    """(doc_id, page, cell, host): the host line on nearly the cell's baseline that ends nearest to its left."""
    near = (F.abs(F.col("c_oy") - F.col("oy")) < 0.35 * F.col("size")) & (F.col("x1") <= F.col("c_x0"))
    c = cells.select("doc_id", "page", F.col("cell"), F.col("oy").alias("c_oy"), F.col("x0").alias("c_x0"))
    return c.join(hosts, ["doc_id", "page"]).filter(near).groupBy("doc_id", "page", "cell").agg(F.max_by("line_no", F.struct("x1", -F.col("line_no"))).alias("host"))


def merged_intervals(rows: DataFrame, *keys: str, gap: int = 0) -> DataFrame:
    """(keys, part, low, high, n): overlapping intervals (low, high) of a key as one; `gap` apart still touch."""
    w = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("low") <= before + gap, 0).otherwise(1)
    numbered = rows.withColumn("new", new).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"))


def column_measures(lines: DataFrame, body: float = 10.0) -> DataFrame:
    """(doc_id, n, left, best_x, best_n, near_miss, justified, right, pitch): a document's column, from its lines.

    left: nearest rank at a tenth. best_x: the right edge that most lines end at within 0.12 of the body size, of equals
    the one further right; counted on the distinct edges. A column is justified if at least 4 lines, 3 of them and two in
    five end there, and hardly any just short of it.
    """
    tol = body * 0.12
    edges = lines.groupBy("doc_id", "x1").agg(F.count("*").alias("k"))
    near = edges.withColumn("n_near", F.expr(f"sum(k) OVER (PARTITION BY doc_id ORDER BY x1 RANGE BETWEEN {tol}D PRECEDING AND {tol}D FOLLOWING)"))
    best = near.groupBy("doc_id").agg(F.max(F.struct("n_near", "x1")).alias("b")).select("doc_id", F.col("b.x1").alias("best_x"), F.col("b.n_near").alias("best_n"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    step = lines.withColumn("d", F.col("line_no") * 12.0 - F.lag(F.col("line_no") * 12.0).over(w)).join(best, "doc_id")
    short = F.col("best_x") - F.col("x1")
    measured = step.groupBy("doc_id", "best_x", "best_n").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("x0")).alias("lefts"), F.array_sort(F.collect_list("d")).alias("steps"),
        F.count_if((short > tol) & (short < 1.2 * body)).alias("near_miss"), F.max("x1").alias("longest"), F.max(F.when(F.abs(short) <= tol, F.col("x1"))).alias("cluster"),
    )
    justified = (F.col("n") >= 4) & (F.col("best_n") >= 3) & (F.col("best_n") * 5 >= F.col("n") * 2) & (F.col("near_miss") <= F.greatest(F.lit(1.0), F.col("n") * 0.1))
    return measured.withColumn("justified", justified).select("doc_id", "n", nearest_rank(F.col("lefts"), 0.1).alias("left"), "best_x", "best_n", "near_miss", "justified", F.when(F.col("justified"), F.col("cluster")).otherwise(F.col("longest")).alias("right"), nearest_rank(F.col("steps"), 0.3).alias("pitch"))


def gutters(chars: DataFrame, step: float = 6.0) -> DataFrame:
    """(doc_id, cell, n_rows): in how many of a document's lines a cell of the column grid is inked; gutters have few."""
    inked = chars.filter("c <> ' '").select("doc_id", F.floor(F.col("x0") / step).alias("cell"), "line_no")
    return inked.distinct().groupBy("doc_id", "cell").agg(F.count("*").alias("n_rows"))


def clear_runs(occupied: DataFrame) -> DataFrame:
    """(doc_id, first, last): runs of cells with no ink between inked ones (gaps and islands)."""
    w = Window.partitionBy("doc_id").orderBy("cell")
    gap = occupied.withColumn("before", F.lag("cell").over(w)).filter(F.col("cell") - F.col("before") > 1)
    return gap.select("doc_id", (F.col("before") + 1).alias("first"), (F.col("cell") - 1).alias("last"))


def line_gaps(chars: DataFrame) -> DataFrame:
    """(doc_id, line_no, n_chars, n_spaces, width, widest): inked characters of a line, the gaps between them, and the widest. chars:
    glyphs as rows, or a line's as one array (lines.line_glyphs)."""
    def measured(x0: Column, x1: Column) -> Column:
        gaps = F.zip_with(F.slice(x0, F.lit(2), F.size(x0)), F.slice(x1, F.lit(1), F.size(x1) - 1), lambda after, before: after - before)
        counts = F.struct(F.size(x0).cast("long").alias("n_chars"), (F.array_max(x1) - F.array_min(x0)).alias("width"))
        return F.when(F.size(x0) > 0, let(gaps, lambda g: F.struct(counts.alias("c"), F.size(F.filter(g, lambda x: x > 0)).cast("long").alias("n_spaces"), F.coalesce(F.array_max(g), F.lit(0.0)).alias("widest"))))

    # let: the arrays are bound once, not worked out anew wherever they are used
    of = let(F.filter("glyphs", lambda g: g["c"] != " "), lambda g: let(F.struct(g["x0"].alias("x0"), g["x1"].alias("x1")), lambda s: measured(s["x0"], s["x1"])))
    rows = gathered(chars, "c", "x0", "x1").select("doc_id", "line_no", F.explode(F.array_compact(F.array(of))).alias("m"))
    return rows.select("doc_id", "line_no", "m.c.n_chars", "m.n_spaces", "m.c.width", "m.widest")


def space_width(gaps: DataFrame, loose: str = "loose", body: float = 10.0) -> DataFrame:
    """(doc_id, space): the natural width of a space: the median of gaps (doc_id, gap, loose) in loose lines if there are
    five, else a low rank of all if there are five, else a quarter of the body; between 0.15 and 0.5 of the body."""
    low = at_ranks(gaps, ["doc_id"], "gap", low=lambda n: half_up((n - 1) * 0.15))
    mid = gaps.filter(loose).groupBy("doc_id").agg(F.median("gap").alias("mid"), F.count("gap").alias("k"))
    both = low.join(mid, "doc_id", "left")
    value = F.when(F.col("k") >= 5, F.col("mid")).when(F.col("n") >= 5, F.col("low")).otherwise(body * 0.25)
    return both.select("doc_id", F.least(F.greatest(value, F.lit(body * 0.15)), F.lit(body * 0.5)).alias("space"))


def reading_order(boxes: DataFrame, width: float) -> DataFrame:
    """boxes (doc_id, page, box_id) with band, column and place: boxes wider than 0.6 of the page part it into bands; in a
    band, left ones come before right ones, each from top to bottom."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "box_id")
    wide = F.col("x1") - F.col("x0") > 0.6 * width
    before = F.coalesce(F.sum(wide.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    banded = boxes.withColumn("wide", wide).withColumn("band", before * 2 + F.when(F.col("wide"), 1).otherwise(0))
    columned = banded.withColumn("column", F.when(F.col("wide"), 0).otherwise(F.when((F.col("x0") + F.col("x1")) / 2 < width / 2, 0).otherwise(1)))
    order = Window.partitionBy("doc_id", "page").orderBy("band", "column", "y0", "x0", "box_id")
    return columned.withColumn("place", F.row_number().over(order)).drop("wide")


def repeated_images(images: DataFrame) -> DataFrame:
    """(px_w, px_h, raw_len, n_pages): images of one size and length that stand on at least two pages."""
    return images.groupBy("px_w", "px_h", "raw_len").agg(F.count_distinct("page_key").alias("n_pages")).filter("n_pages >= 2")
