"""Regions of recognised pages: reading order by bands and columns, readings over base lines, pieces of one image, tables of labels, columns of numbers.

A page's boxes are an array where a choice depends on earlier ones; such arrays hold boxes of one band or page. All else are joins on
document and page, by cells of a grid where boxes meet, and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import let
from quire.operators.rounds import components, settled

PAGE = ["doc_id", "page"]
#: Labels of regions that are read by themselves.
APART = ("image_text", "aside_text", "vertical_text")
#: Signs of kana.
KANA = "[ぁ-ゟ゠-ヿー・]"
HAN = r"\p{IsHan}"


# reading order


def ordered_regions(boxes: DataFrame, wide: float = 0.78, least: float = 0.3) -> DataFrame:
    """boxes (doc_id, page, box_id, x0, y0, x1, y1, label, page_w) with place and scope: wide ones part a page into bands; in a band, columns go from left
    to right, and their boxes downwards.

    From left to right, a box goes to the column that it shares most of the narrower one's width with, if that is `least`
    or more, and makes it wider; else it begins a column. scope: which boxes are read as one: those of a column in a band,
    of its sides apart; texts in images by themselves. Equal boxes go by box_id.
    """
    is_wide = F.col("x1") - F.col("x0") >= F.col("page_w") * wide
    down = Window.partitionBy(*PAGE).orderBy("y0", "x0", "box_id")
    wides = boxes.filter(is_wide).withColumn("nth", F.row_number().over(down) - 1)
    mids = wides.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", ((F.col("y0") + F.col("y1")) / 2).alias("m")))), lambda x: x["m"]).alias("mids"))
    narrow = boxes.filter(~F.coalesce(is_wide, F.lit(False))).join(mids, PAGE, "left")
    cy = (F.col("y0") + F.col("y1")) / 2
    first = F.array_position(F.transform("mids", lambda m: cy < m), F.lit(True))
    banded = narrow.withColumn("band", F.when(F.col("mids").isNull(), 0).when(first > 0, first - 1).otherwise(F.size("mids")).cast("int"))
    band = banded.groupBy(*PAGE, "band").agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "box_id", "x1", "y1", "label"))).alias("b"))
    start = F.struct(F.array().cast("array<struct<x0:double,x1:double>>").alias("cols"), F.array().cast("array<int>").alias("at"))

    def put(s: Column, b: Column) -> Column:
        share = F.transform(s["cols"], lambda c: F.greatest(F.lit(0.0), F.least(c["x1"], b["x1"]) - F.greatest(c["x0"], b["x0"])) / F.greatest(F.lit(1.0), F.least(c["x1"] - c["x0"], b["x1"] - b["x0"])))
        best = F.array_position(share, F.array_max(share)).cast("int") - 1
        grown = F.transform(s["cols"], lambda c, i: F.when(i == best, F.struct(F.least(c["x0"], b["x0"]).alias("x0"), F.greatest(c["x1"], b["x1"]).alias("x1"))).otherwise(c))
        fresh = F.struct(F.concat(s["cols"], F.array(F.struct(b["x0"].cast("double").alias("x0"), b["x1"].cast("double").alias("x1")))).alias("cols"), F.concat(s["at"], F.array(F.size(s["cols"]))).alias("at"))
        return F.when(F.coalesce(F.array_max(share), F.lit(0.0)) < least, fresh).otherwise(F.struct(grown.alias("cols"), F.concat(s["at"], F.array(best)).alias("at")))

    done = band.withColumn("s", F.aggregate("b", start, put))
    # columns from left to right, as they began where they start alike
    rank = F.transform("s.cols", lambda c, i: F.size(F.filter("s.cols", lambda d, j: (d["x0"] < c["x0"]) | ((d["x0"] == c["x0"]) & (j < i)))))
    flat = done.select(*PAGE, "band", F.explode(F.arrays_zip(F.col("b"), F.transform("s.at", lambda k: F.get(rank, k)).alias("column"))).alias("z")).select(*PAGE, "band", "z.column", "z.b.*")
    row = F.row_number().over(Window.partitionBy(*PAGE, "band", "column").orderBy("y0", "x0", "box_id")) - 1
    kind = F.when(F.col("label").isin("aside_text", "vertical_text"), "aside").otherwise("body")
    scope = F.when(F.col("label") == "image_text", F.format_string("image-b%d-c%d-r%d", "band", "column", "row")).otherwise(F.format_string("%s-b%d-c%d", kind, "band", "column"))
    narrow = flat.withColumn("row", row).select(*PAGE, "box_id", F.struct((F.col("band") * 2).alias("a"), F.col("column").cast("int").alias("b"), "row").alias("at"), scope.alias("scope"))
    wides = wides.select(*PAGE, "box_id", F.struct((F.col("nth") * 2 + 1).cast("int").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("row")).alias("at"), F.when(F.col("label") == "image_text", F.format_string("image-wide-%d", "nth")).otherwise(F.format_string("wide-%d", "nth")).alias("scope"))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("at")) - 1
    return boxes.join(narrow.unionByName(wides).withColumn("place", place).drop("at"), [*PAGE, "box_id"])


def compacted_regions(ordered: DataFrame) -> DataFrame:
    """(doc_id, page, place, scope, label, x0, y0, x1, y1, n): ordered regions with those of one scope as one box, where its first one stands; texts in images and
    at the sides stay by themselves."""
    key = F.when(F.coalesce(F.col("label").isin(*APART), F.lit(False)), F.col("box_id").cast("string"))
    first = lambda c: F.min_by(c, "place").alias(c)
    return ordered.groupBy(*PAGE, "scope", key.alias("by")).agg(F.min("place").alias("place"), first("label"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n")).drop("by")


# readings


def readings(lines: DataFrame, cell: float = 64.0) -> DataFrame:
    """(doc_id, page, line_no, base, start, stop, reading): small lines of kana and the base line that each of them reads, with the characters it stands over.

    lines: doc_id, page, line_no, text, x0, y0, x1, y1. A reading has up to 24 characters, of which 0.72 or more are kana, is at most 0.72
    as high as its base, and stands right above it, over 0.3 of the narrower one. Of several bases the one with the least gap
    counts, the shift of their middles added at 0.08, and of equal ones the first. The Han characters under it are its own, and those
    next to them that reach out of it by a fifth at most.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    meant = F.length(F.regexp_replace(text, rf"(?!{KANA})[^\p{{L}}\p{{N}}]", ""))
    kana = F.length(text) - F.length(F.regexp_replace(text, KANA, ""))
    small = lines.select(*PAGE, "line_no", text.alias("reading"), *(F.col(c).alias("r_" + c) for c in ("x0", "y0", "x1", "y1"))).filter((F.length("reading") > 0) & (F.length("reading") <= 24) & F.coalesce(F.try_divide(F.lit(1.0) * kana, meant) >= 0.72, F.lit(False)))
    h = F.col("y1") - F.col("y0")
    bases = lines.filter(F.col("text").rlike(HAN) & (F.col("x1") > F.col("x0"))).withColumns({"h": h, "n": F.length("text")}).withColumnRenamed("line_no", "base")
    bases = bases.withColumn("cell", F.explode(F.sequence(F.floor((F.col("y0") - h * 0.8) / cell), F.floor((F.col("y0") + h * 0.33) / cell))))
    met = small.withColumn("cell", F.floor(F.col("r_y1") / cell)).join(bases, [*PAGE, "cell"]).filter(F.col("base") != F.col("line_no"))
    rh, gap, rw, w = F.col("r_y1") - F.col("r_y0"), F.col("y0") - F.col("r_y1"), F.col("r_x1") - F.col("r_x0"), F.col("x1") - F.col("x0")
    over = F.greatest(F.lit(0.0), F.least("r_x1", "x1") - F.greatest("r_x0", "x0"))
    met = met.filter((rh <= F.col("h") * 0.72) & (F.col("y0") >= F.col("r_y0")) & (gap >= rh * -0.45) & (gap <= F.col("h") * 0.8) & (over >= F.least(rw, w) * 0.3))
    # a base line is counted once, before it meets its readings
    n, step = F.col("n"), w / F.col("n")
    low, high = F.greatest(F.lit(0), F.floor((F.col("r_x0") - F.col("x0")) / w * n) - 1).cast("int"), F.least(n, F.ceil((F.col("r_x1") - F.col("x0")) / w * n) + 1).cast("int")
    first, last = F.ceil((F.col("r_x0") - rw * 0.2 - F.col("x0")) / step).cast("int") - 1, F.floor((F.col("r_x1") + rw * 0.2 - F.col("x0")) / step).cast("int") + 1
    # what a reading may take stands between these places; the rest of the base line is left aside at once, so a long line's readings cost little each
    at, to = F.greatest(F.lit(0), F.least(low, first)), F.least(n, F.greatest(high, last))
    middle = lambda i: F.col("x0") + (i + 0.5) * w / n

    def taken(s: Column) -> Column:
        hits = F.when(s["high"] > s["low"], F.filter(F.sequence(s["low"], s["high"] - 1), lambda i: middle(i).between(F.col("r_x0"), F.col("r_x1")) & F.substring(s["near"], i - s["at"] + 1, F.lit(1)).rlike(HAN)))
        return let(hits, lambda i: F.when(F.size(i) > 0, reach(s, F.array_min(i), F.array_max(i) + 1)))

    def reach(s: Column, a: Column, z: Column) -> Column:
        before = F.length(F.regexp_extract(F.substring(s["near"], F.lit(1), a - s["at"]), rf"(?:(?<!{HAN}){HAN}++)?\z", 0))
        behind = F.length(F.regexp_extract(F.substring(s["near"], z - s["at"] + 1, F.length(s["near"])), rf"^{HAN}*", 0))
        return F.struct(F.least(a, F.greatest(a - before, s["first"])).cast("int").alias("start"), F.greatest(z, F.least(z + behind, s["last"])).cast("int").alias("stop"))

    bounds = {"low": low, "high": high, "first": first, "last": last, "at": at, "near": F.substring("text", at + 1, F.greatest(to - at, F.lit(0)))}
    score = F.abs(gap) + F.abs((F.col("r_x0") + F.col("r_x1") - F.col("x0") - F.col("x1")) / 2) * 0.08
    # no filter before the sum: it would go down into the join and be worked out twice
    met = met.select(*PAGE, "line_no", "base", "reading", score.alias("score"), let(F.struct(*(v.alias(k) for k, v in bounds.items())), taken).alias("t"))
    best = met.groupBy(*PAGE, "line_no").agg(F.min(F.when(F.col("t").isNotNull(), F.struct("score", "base", "t.start", "t.stop", "reading"))).alias("b")).filter("b is not null")
    return best.select(*PAGE, "line_no", "b.base", "b.start", "b.stop", "b.reading")


def with_readings(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, html): base lines with their readings behind the characters in brackets, and as ruby elements; of readings that overlap, the first."""
    from quire.functions.scalars import escaped

    by_line = found.groupBy(*PAGE, F.col("base").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "line_no", "reading"))).alias("r"))
    part = lambda a, b: F.substring("text", a + 1, b - a)
    esc = lambda t: escaped(t, quotes=False)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("plain"), F.lit("").alias("html"))

    def step(s: Column, p: Column) -> Column:
        gap, base = part(s["at"], p["start"]), part(p["start"], p["stop"])
        return F.when(p["start"] < s["at"], s).otherwise(F.struct(p["stop"].alias("at"), F.concat(s["plain"], gap, base, F.lit("（"), p["reading"], F.lit("）")).alias("plain"), F.concat(s["html"], esc(gap), F.lit("<ruby>"), esc(base), F.lit("<rt>"), esc(p["reading"]), F.lit("</rt></ruby>")).alias("html")))

    done = lines.join(by_line, [*PAGE, "line_no"]).withColumn("s", F.aggregate("r", start, step))
    rest = part(F.col("s.at"), F.length("text"))
    return done.select(*PAGE, "line_no", F.concat("s.plain", rest).alias("plain"), F.concat("s.html", esc(rest)).alias("html")).withColumnRenamed("plain", "text")


# pieces of one image


def image_pieces(images: DataFrame, glyphs: DataFrame, cell: float = 128.0) -> DataFrame:
    """(doc_id, page, box_id, group_id, overlay): images (doc_id, page, box_id, x0, y0, x1, y1, page_w, page_h) that are pieces of one, by the smallest box_id.

    Pieces stand on or beside each other with equal sides, to within 2 points, unless both have text of three characters or more on them;
    or one covers a tenth of the smaller one, neither has text, nor half of the page (overlay). Images of less than
    5 points are left out. glyphs: doc_id, page, x0, y0, x1, y1.
    """
    clip = lambda c, most: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(most)))
    known_boxes = images.select(*PAGE, "box_id", *(clip(c, "page_w" if c[0] == "x" else "page_h").alias(c) for c in ("x0", "y0", "x1", "y1")), (F.col("page_w") * F.col("page_h")).alias("whole")).filter("x1 - x0 >= 5 and y1 - y0 >= 5")
    centre = glyphs.select(*PAGE, ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    text = known_boxes.join(centre, PAGE).filter("cx > x0 and cx < x1 and cy > y0 and cy < y1").groupBy(*PAGE, "box_id").agg(F.count("*").alias("n_text"))
    rows = known_boxes.join(text, [*PAGE, "box_id"], "left").fillna(0, ["n_text"]).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    place = lambda c, by: F.floor((F.col(c) + by) / cell)
    dealt = rows.withColumns({"in_x": place("x0", -2), "in_y": place("y0", -2)})
    dealt = dealt.withColumn("cell_x", F.explode(F.sequence("in_x", place("x1", 2)))).withColumn("cell_y", F.explode(F.sequence("in_y", place("y1", 2))))
    a, b = (dealt.select(*PAGE, "cell_x", "cell_y", *(F.col(c).alias(f"{p}_{c}") for c in ("box_id", "x0", "y0", "x1", "y1", "n_text", "area", "in_x", "in_y")), *(["whole"] if p == "a" else [])) for p in "ab")
    # two boxes meet in the first cell that both have
    once = (F.col("cell_x") == F.greatest("a_in_x", "b_in_x")) & (F.col("cell_y") == F.greatest("a_in_y", "b_in_y"))
    near = lambda p, q: F.abs(F.col(p) - F.col(q)) <= 2
    upright = near("a_x0", "b_x0") & near("a_x1", "b_x1") & (near("a_y1", "b_y0") | near("b_y1", "a_y0"))
    level = near("a_y0", "b_y0") & near("a_y1", "b_y1") & (near("a_x1", "b_x0") | near("b_x1", "a_x0"))
    shared = F.greatest(F.lit(0.0), F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")) * F.greatest(F.lit(0.0), F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"))
    over = (F.greatest("a_area", "b_area") < F.col("whole") * 0.5) & (shared >= F.least("a_area", "b_area") * 0.1) & (F.greatest("a_n_text", "b_n_text") < 3)
    cards = (upright | level) & (F.least("a_n_text", "b_n_text") >= 3)
    links = a.join(b, [*PAGE, "cell_x", "cell_y"]).filter((F.col("a_box_id") > F.col("b_box_id")) & once & (upright | level | over))
    # written, as both what hangs together and what is laid over come from them
    links = settled(links.select(*PAGE, F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), (~cards).alias("one"), (over & ~upright & ~level).alias("over")))
    known = components(links.filter("one").select(*PAGE, "a", "b"), PAGE).select(*PAGE, F.col("node").alias("box_id"), F.col("label").alias("group_id"))
    laid = links.filter("over").select(*PAGE, F.explode(F.array("a", "b")).alias("box_id")).distinct().withColumn("overlay", F.lit(True))
    out = known_boxes.select(*PAGE, "box_id").join(known, [*PAGE, "box_id"], "left").join(laid, [*PAGE, "box_id"], "left")
    return out.select(*PAGE, "box_id", F.coalesce("group_id", "box_id").alias("group_id"), F.coalesce("overlay", F.lit(False)).alias("overlay"))


# tables of labels, columns of numbers


def label_rows(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, row, cells): dark boxes (doc_id, page, box_id, x0, y0, x1, y1) of one height: a box joins the first row whose first box begins and ends
    at its height, to within 2 points; cells are a row's boxes from left to right, as (x0, x1, y0, y1, box_id)."""
    down = F.array_sort(F.collect_list(F.struct("y0", "x0", "box_id", "x1", "y1")))
    start = F.struct(F.array().cast("array<struct<y0:double,y1:double>>").alias("rows"), F.array().cast("array<int>").alias("at"))

    def put(s: Column, b: Column) -> Column:
        at = F.array_position(F.transform(s["rows"], lambda r: (F.abs(r["y0"] - b["y0"]) <= 2) & (F.abs(r["y1"] - b["y1"]) <= 2)), F.lit(True)).cast("int") - 1
        fresh = F.struct(F.concat(s["rows"], F.array(F.struct(b["y0"].cast("double").alias("y0"), b["y1"].cast("double").alias("y1")))).alias("rows"), F.concat(s["at"], F.array(F.size(s["rows"]))).alias("at"))
        return F.when(at < 0, fresh).otherwise(F.struct(s["rows"].alias("rows"), F.concat(s["at"], F.array(at)).alias("at")))

    done = boxes.groupBy(*PAGE).agg(down.alias("b")).withColumn("s", F.aggregate("b", start, put))
    flat = done.select(*PAGE, F.explode(F.arrays_zip(F.col("b"), F.col("s.at").alias("row"))).alias("z")).select(*PAGE, "z.row", "z.b.*")
    return flat.groupBy(*PAGE, "row").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "y0", "y1", "box_id"))).alias("cells"), F.min_by("y0", F.struct("y0", "x0", "box_id")).alias("y0"), F.min_by("y1", F.struct("y0", "x0", "box_id")).alias("y1"))


def label_tables(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, row, col, label, value): labels in dark boxes and the text to their right, of two rows or more with the same columns that stand
    on each other, 6 points apart at most.

    A value reaches to the next label, in the last column as far as its rows' text does. words: doc_id, page, ci, w, x0, x1, y0, y1, oy, size, in
    reading order by oy and x0; a space is put where a line ends or a gap is wider than a fifth of the size. Rows are numbered as
    their first boxes come, downwards.
    """
    rows = label_rows(boxes)
    w = Window.partitionBy(*PAGE).orderBy("row")
    same = F.forall(F.arrays_zip(F.col("cells").alias("p"), F.lag("cells").over(w).alias("q")), lambda z: (F.abs(z["p"]["x0"] - z["q"]["x0"]) <= 2) & (F.abs(z["p"]["x1"] - z["q"]["x1"]) <= 2))
    goes_on = F.coalesce((F.size("cells") == F.size(F.lag("cells").over(w))) & same & (F.col("y0") - F.lag("y1").over(w) <= 6), F.lit(False))
    grouped = rows.withColumn("new", (~goes_on).cast("int")).withColumn("g", F.sum("new").over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*PAGE, "g"))).filter("n >= 2")
    block = Window.partitionBy(*PAGE, "g").orderBy("row")
    grouped = grouped.withColumns({"r": F.row_number().over(block) - 1, "labels": F.first("cells").over(block), "top": F.first("y0").over(block), "bottom": F.last("y1").over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    ink = words.select(*PAGE, "ci", "w", "oy", "size", F.col("x0").alias("w_x0"), F.col("x1").alias("w_x1"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    last = F.element_at("labels", -1)["x1"]
    tables = grouped.filter("r = 0").select(*PAGE, "g", "labels", "top", "bottom", last.alias("last"))
    reach = tables.join(ink, PAGE).filter((F.col("cy") > F.col("top")) & (F.col("cy") < F.col("bottom")) & (F.col("w_x0") >= F.col("last"))).groupBy(*PAGE, "g").agg((F.max("w_x1") + 6).alias("far"))
    tables = tables.join(reach, [*PAGE, "g"], "left").withColumn("far", F.coalesce("far", F.col("last") + 60)).withColumn("table_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("g")) - 1)
    cells = grouped.select(*PAGE, "g", "r", F.col("y0").alias("top"), F.col("y1").alias("bottom"), F.posexplode("cells").alias("col", "c")).join(tables.select(*PAGE, "g", "table_no", "labels", "far"), [*PAGE, "g"])
    own = F.get("labels", F.col("col"))
    areas = F.array(F.struct(F.lit("label").alias("kind"), F.col("c.x0").alias("a"), F.col("c.x1").alias("b")), F.struct(F.lit("value").alias("kind"), own["x1"].alias("a"), F.coalesce(F.get("labels", F.col("col") + 1)["x0"], F.col("far")).alias("b")))
    held = cells.select(*PAGE, "table_no", "r", "col", "top", "bottom", F.explode(areas).alias("k")).select(*PAGE, "table_no", "r", "col", "top", "bottom", "k.*")
    inside = held.join(ink, PAGE).filter(F.col("cx").between(F.col("a"), F.col("b")) & F.col("cy").between(F.col("top"), F.col("bottom")))
    order = Window.partitionBy(*PAGE, "table_no", "r", "col", "kind").orderBy("oy", "w_x0", "ci")
    apart = (F.abs(F.col("oy") - F.lag("oy").over(order)) >= F.col("size") * 0.5) | (F.col("w_x0") - F.lag("w_x1").over(order) > F.col("size") * 0.2)
    pieces = inside.withColumns({"t": F.concat(F.when(apart, " ").otherwise(""), "w"), "k": F.row_number().over(order)})
    texts = pieces.groupBy(*PAGE, "table_no", "r", "col", "kind").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda p: p["t"]), "")).alias("t"))
    both = texts.groupBy(*PAGE, "table_no", "r", "col").agg(F.max(F.when(F.col("kind") == "label", F.col("t"))).alias("label"), F.max(F.when(F.col("kind") == "value", F.col("t"))).alias("value"))
    out = cells.select(*PAGE, "table_no", "r", "col").join(both, [*PAGE, "table_no", "r", "col"], "left")
    return out.select(*PAGE, F.col("table_no").cast("int").alias("table_no"), F.col("r").cast("int").alias("row"), "col", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("value", F.lit("")).alias("value"))


def number_columns(glyphs: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, page, row, first, last): short runs of digits that end at one height of the page's width in `least` rows or more: columns of numbers beside a text.

    glyphs: doc_id, page, row, ci, c, x0, x1, size. A run has up to four digits, less than 0.3 of their size apart, more than half of it behind
    what is before it, and more than three times it before what follows. Runs in the order of the rows: each that isn't taken yet takes
    all others that end within 0.4 of the larger size, if there are enough. first and last: their glyphs' ci.
    """
    w = Window.partitionBy(*PAGE, "row").orderBy("ci")
    digit = F.col("c").rlike("^[0-9]")
    rows = glyphs.withColumns({"d": digit, "before": F.lag("x1").over(w), "after": F.lead("x0").over(w), "b_size": F.lag("size").over(w)}).withColumn("b_d", F.lag("d").over(w))
    joined = F.coalesce(F.col("d") & F.col("b_d") & (F.col("x0") - F.col("before") < F.col("b_size") * 0.3), F.lit(False))
    runs = rows.withColumn("run", F.sum(F.when(joined, 0).otherwise(1)).over(w)).filter("d").groupBy(*PAGE, "row", "run").agg(
        F.min("ci").alias("first"), F.max("ci").alias("last"), F.count("*").alias("n"), F.min_by("size", "ci").alias("size"), F.min_by(F.struct("x0", "before"), "ci").alias("l"), F.max_by(F.struct("x1", "after"), "ci").alias("r"),
    )
    free = F.coalesce(F.col("l.x0") - F.col("l.before") > F.col("size") * 0.5, F.lit(True)) & F.coalesce(F.col("r.after") - F.col("r.x1") > F.col("size") * 3, F.lit(True))
    found = runs.filter((F.col("n") <= 4) & free).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("row", "first", "last", F.col("r.x1").alias("x1"), "size"))).alias("c"))
    alike = lambda a, b: F.abs(a["x1"] - b["x1"]) < F.greatest(a["size"], b["size"]) * 0.4

    def take(used: Column, k: Column) -> Column:
        c = F.get("c", k)
        same = F.filter(F.sequence(F.lit(0), F.size("c") - 1), lambda j: ~F.array_contains(used, j) & alike(F.get("c", j), c))
        return F.when(F.array_contains(used, k) | (F.size(same) < least), used).otherwise(F.concat(used, same))

    used = F.aggregate(F.sequence(F.lit(0), F.size("c") - 1), F.array().cast("array<int>"), take)
    return found.select(*PAGE, F.explode(F.transform(used, lambda k: F.get("c", k))).alias("x")).select(*PAGE, "x.row", "x.first", "x.last")
