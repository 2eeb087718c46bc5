"""Rows of glyphs: what crosses a column's edge, what is split there, ornaments, titles over columns, turned lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import half_up
from quire.operators.boxes import BOX, per_page

PAGE = ["doc_id", "page"]
ROW = [*PAGE, "line_no"]


def row_covers(glyphs: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, cut): cuts (doc_id, page, cut) of a page that a row of glyphs (ci, x0, x1, size) runs over: one
    stands on the cut, or the gap there is smaller than half of the size of the glyph before it."""
    w = Window.partitionBy(*ROW).orderBy("ci")
    both = glyphs.withColumn("next", F.lead("x0").over(w)).join(cuts, PAGE)
    on = (F.col("x0") <= F.col("cut")) & (F.col("x1") >= F.col("cut"))
    gap = (F.col("x1") <= F.col("cut")) & (F.col("next") >= F.col("cut")) & (F.col("next") - F.col("x1") < F.col("size") * 0.5)
    return both.filter(on | gap).select(*ROW, "cut").distinct()


def split_at_edges(segments: DataFrame, glyphs: DataFrame, tables: DataFrame, above: float = 80.0) -> DataFrame:
    """(doc_id, page, line_no, table_id, n_left, n_right): segments (oy) near a table that stand on both sides of its left edge
    with a gap of a character there. glyphs: doc_id, page, line_no, ci, x0, x1, size; tables: doc_id, page, table_id, x0, y0, y1."""
    t = tables.select(*PAGE, "table_id", F.col("x0").alias("edge"), F.col("y0").alias("t0"), F.col("y1").alias("t1"))
    near = segments.join(t, PAGE).filter((F.col("oy") >= F.col("t0") - above) & (F.col("oy") <= F.col("t1"))).select(*ROW, "table_id", "edge")
    left = F.col("x1") <= F.col("edge") + 1
    sides = near.join(glyphs, ROW).groupBy(*ROW, "table_id").agg(
        F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"), F.max_by("x1", F.when(left, F.col("ci"))).alias("l"), F.min_by("x0", F.when(~left, F.col("ci"))).alias("r"), F.min_by("size", F.when(left, F.col("ci"))).alias("s")
    )
    return sides.filter("n_left > 0 and n_right > 0 and r - l >= s").select(*ROW, "table_id", "n_left", "n_right")


def ornaments(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, ci): a row's first or last glyph that is twice as large as its upper median size, stands off by
    1.5 of it and is of another font family; rows of fewer than four glyphs have none. glyphs: ci, x0, x1, size, font."""
    w, whole = Window.partitionBy(*ROW).orderBy("ci"), Window.partitionBy(*ROW)
    family = F.lower(F.regexp_extract(F.regexp_replace("font", r"^[A-Z]{6}\+", ""), "^([^,-]*)", 1))
    r = glyphs.withColumns({"f": family, "i": F.row_number().over(w), "n": F.count("*").over(whole), "rank": F.row_number().over(whole.orderBy("size"))})
    r = r.withColumns({"body": F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2) + 1, F.col("size"))).over(whole)})
    r = r.withColumns({f"{c}_{s}": (F.lead(c) if s == "n" else F.lag(c)).over(w) for c in ("x0", "x1", "f") for s in ("n", "p")})
    first = (F.col("i") == 1) & (F.col("x0_n") - F.col("x1") > F.col("body") * 1.5) & (F.col("f") != F.col("f_n"))
    last = (F.col("i") == F.col("n")) & (F.col("x0") - F.col("x1_p") > F.col("body") * 1.5) & (F.col("f") != F.col("f_p"))
    return r.filter((F.col("n") >= 4) & (F.col("size") >= F.col("body") * 2) & (first | last)).select(*ROW, "ci")


def spanning_titles(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, page, line_no): segments (col, x0, x1, oy, size) in the middle of their flow (spans: doc_id, page, x0, x1, body)
    that begin off their column's edge, or are large and above all other columns, with no text of another column near."""
    f = spans.select(*PAGE, F.col("x0").alias("s0"), F.col("x1").alias("s1"), "body")
    edge, whole = F.min("x0").over(Window.partitionBy(*PAGE, "col")), Window.partitionBy(*PAGE)
    inner = segments.filter("col >= 0").withColumn("edge", edge)
    tops = inner.groupBy(*PAGE, "col").agg(F.min("oy").alias("top")).withColumn("all_tops", F.collect_list(F.struct("col", "top")).over(whole))
    r = inner.join(tops.drop("top"), [*PAGE, "col"]).join(f, PAGE)
    others = F.array_min(F.transform(F.filter("all_tops", lambda t: t["col"] != F.col("col")), lambda t: t["top"]))
    middle = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("s0") + F.col("s1")) / 2) <= F.greatest(F.col("size") * 1.5, (F.col("s1") - F.col("s0")) * 0.03)
    above = (F.col("size") > F.col("body") * 1.3) & (others.isNull() | (others > F.col("oy")))
    some = r.filter(middle & ((F.col("x0") - F.col("edge") > F.col("size")) | above)).select(*ROW, "col", "oy", "body")
    other = inner.select(*PAGE, F.col("col").alias("o_col"), F.col("oy").alias("o_oy"), F.col("size").alias("o_size"))
    close = (F.col("o_col") != F.col("col")) & (F.abs(F.col("o_oy") - F.col("oy")) < F.greatest(F.col("body") * 1.25, F.col("o_size")) * 1.5)
    met = some.join(other, PAGE).filter(close).select(*ROW).distinct()
    return some.select(*ROW).join(met, ROW, "left_anti")


def turned_lines(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, turn, track, text): lines of turned text, by their angle to a twentieth and their distance across it to
    five points, with a space where glyphs stand apart. glyphs: doc_id, page, ci, c, ox, oy, angle, size."""
    a = F.col("angle")
    u, v = F.col("ox") * F.cos(a) - F.col("oy") * F.sin(a), F.col("ox") * F.sin(a) + F.col("oy") * F.cos(a)
    key = [*PAGE, "turn", "track"]
    rows = glyphs.filter(F.trim("c") != "").select(*PAGE, "ci", "c", "size", F.round(u, 6).alias("u"), half_up(a * 20).alias("turn"), half_up(v / 5).alias("track"))
    w = Window.partitionBy(*key).orderBy("u", "ci")
    rows = rows.withColumn("step", F.col("u") - F.lag("u").over(w))
    # the step at nearest rank 0.3 of the positive ones, by their order: windows over the same rows, no join
    whole, ahead = Window.partitionBy(*key), F.coalesce(F.col("step") > 0, F.lit(False))
    rows = rows.withColumns({"i": F.row_number().over(whole.orderBy(F.desc(ahead), "step")), "n": F.count_if(ahead).over(whole)})
    rows = rows.withColumn("usual", F.max(F.when(ahead & (F.col("i") == half_up((F.col("n") - 1) * 0.3) + 1), F.col("step"))).over(whole))
    spaced = rows.withColumn("t", F.concat(F.when(F.col("step") > F.col("usual") * 1.2 + F.col("size") * 0.1, " ").otherwise(""), "c"))
    parts = F.array_sort(F.collect_list(F.struct("u", "ci", "t")))
    return spaced.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def kept_chars(glyphs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page, box_id, para): paragraphs of which a glyph touches a box, but at most half have their centre in it, so
    their characters stay text. glyphs: doc_id, page, para, x0, y0, x1, y1."""
    b = boxes.select(*PAGE, "box_id", *(F.col(c).alias("b_" + c) for c in ("x0", "y0", "x1", "y1")))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    centre = x.between(F.col("b_x0"), F.col("b_x1")) & y.between(F.col("b_y0"), F.col("b_y1"))
    touch = (F.col("x1") > F.col("b_x0")) & (F.col("x0") < F.col("b_x1")) & (F.col("y1") > F.col("b_y0")) & (F.col("y0") < F.col("b_y1"))
    met = glyphs.join(b, PAGE).groupBy(*PAGE, "box_id", "para").agg(F.bool_or(touch).alias("touch"), F.count_if(centre).alias("in"), F.count("*").alias("n"))
    return met.filter("touch and in * 2 <= n").select(*PAGE, "box_id", "para")


def listed_figures(figures: DataFrame, cover: float = 0.7) -> DataFrame:
    """(doc_id, page, box_id): figures (kind, x0..y1, page_w, page_h) to list: figures proper, small ones drawn into a figure
    that covers `cover` of its page, and panels smaller than that."""
    area, page = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.col("page_w") * F.col("page_h")
    covers = figures.filter((F.col("kind") == "figure") & (area >= page * cover)).select(*PAGE, *(F.col(c).alias("c_" + c) for c in ("x0", "y0", "x1", "y1")))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (x > F.col("c_x0")) & (x < F.col("c_x1")) & (y > F.col("c_y0")) & (y < F.col("c_y1"))
    drawn = figures.filter("kind = 'inside-drawn'").join(covers, PAGE).filter(inside).select(*PAGE, "box_id").distinct()
    own = figures.filter((F.col("kind") == "figure") | ((F.col("kind") == "panel") & (area < page * cover))).select(*PAGE, "box_id")
    return own.unionByName(drawn)


def joined_fragments(lines: DataFrame, reach: float = 2.5) -> DataFrame:
    """(doc_id, page, line_no, text, x0, y0, x1, y1, n): pieces of recognised lines on one height that stand close, as one, over
    and over until none are left to join; line_no is the first piece's. A page's lines are one small group."""

    def work(rows: list[tuple]) -> list[list]:
        todo = [[*r, 1] for r in rows]
        wide = lambda a: (a[4] - a[2]) / max(1, len("".join(a[1].split())))
        # widths are worked out once for each piece, not for each pair
        widths = [wide(a) for a in todo]
        i = 0
        while i < len(todo):
            a = todo[i]
            for j, b in enumerate(todo):
                gap = b[2] - a[4]
                if gap >= 0 and j != i and gap <= reach * max(widths[i], widths[j], 1) and min(a[5], b[5]) - max(a[3], b[3]) >= 0.6 * min(a[5] - a[3], b[5] - b[3]):
                    todo[i] = [a[0], f"{a[1]} {b[1]}", min(a[2], b[2]), min(a[3], b[3]), max(a[4], b[4]), max(a[5], b[5]), a[6] + b[6]]
                    widths[i] = wide(todo[i])
                    del todo[j], widths[j]
                    i = -1
                    break
            i += 1
        return todo

    places = (F.col(c).cast("double").alias(c) for c in BOX)
    return per_page(lines.select(*ROW, "text", *places), ["line_no", "text", *BOX], work, "line_no int, text string, x0 double, y0 double, x1 double, y1 double, n int")
