"""Columns of a page from the white between them.

glyphs: (doc_id, page, row, ci, x0, x1, size), ci giving their order in a row; rows: (doc_id, page, row, oy, size);
pages: (doc_id, page, page_w, page_h). How many rows have ink at an x is known from where their stretches of ink begin and end: one
running sum over these places, not a value for each point of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.rounds import settled

PAGE = ["doc_id", "page"]
ROW = ["doc_id", "page", "row"]


def _middle(values: Column) -> Column:
    """The median of a sorted array: the mean of both middle ones if there are two."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def body_rows(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows with body, that tell where columns are: not those in the upper or lower 7 % unless they are larger than the rest, nor much smaller
    ones; pages with fewer than 6 of them have none."""
    body = rows.groupBy(*PAGE).agg(F.median("size").alias("body"))
    edge = (F.col("oy") < F.col("page_h") * 0.07) | (F.col("oy") > F.col("page_h") * 0.93)
    kept = rows.join(body, PAGE).join(pages, PAGE).filter(~(edge & (F.col("size") < F.col("body") * 1.2)) & (F.col("size") >= F.col("body") * 0.75))
    return kept.withColumn("n_rows", F.count("*").over(Window.partitionBy(*PAGE))).filter("n_rows >= 6").select(*ROW, "oy", F.col("size").alias("row_size"), "body", "page_w", "n_rows")


def ink_stretches(glyphs: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, page, row, low, high): stretches of ink in each row, in whole points: gaps of less than a character's size are none."""
    w = Window.partitionBy(*ROW).orderBy("ci")
    after = F.lead("x0").over(w)
    right = F.when(after - F.col("x1") < F.col("size"), after).otherwise(F.col("x1"))
    spans = glyphs.withColumn("_right", right).join(kept.select(*ROW, "page_w"), ROW)
    spans = spans.select(*ROW, F.greatest(F.lit(0), F.floor("x0")).alias("a"), F.least(F.ceil("page_w"), F.ceil("_right")).alias("b")).filter("a <= b")
    o = Window.partitionBy(*ROW).orderBy("a", "b")
    before = F.max("b").over(o.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("_new", F.when(F.col("a") <= before + 1, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*ROW, "_part").agg(F.min("a").alias("low"), F.max("b").alias("high")).drop("_part")


def occupancy(stretches: DataFrame) -> DataFrame:
    """(doc_id, page, x, upto, n): in how many rows there is ink at x, x + 1 and so on up to before upto."""
    ends = stretches.select(*PAGE, F.explode(F.array(F.struct(F.col("low").alias("x"), F.lit(1).alias("d")), F.struct((F.col("high") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*PAGE, "e.x").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*PAGE).orderBy("x")
    return steps.select(*PAGE, "x", F.lead("x").over(w).alias("upto"), F.sum("d").over(w).alias("n")).filter("upto is not null")


def _extents(glyphs: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, page, row, first, last, x0_min, x0_max, x1_min, x1_max): where each row's first glyph begins and its last one ends, and where any do."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("x0", "x1") for f, n in ((F.min, "min"), (F.max, "max"))]
    return glyphs.join(kept.select(*ROW), ROW, "left_semi").groupBy(*ROW).agg(F.min_by("x0", "ci").alias("first"), F.max_by("x1", "ci").alias("last"), *ends)


def valleys(stretches: DataFrame, extents: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, page, low, high, cut, n_split, n_cross): bands that hardly any row has ink in, and that enough rows leave free.

    A band is at least 0.8 of the usual size wide, and at most 3 rows or a tenth of them have ink at any of its points. Three rows
    go on at both its sides, or three stand at either side alone; rows across it are much fewer. cut: its emptiest
    point, of equal ones the one next to its middle.
    """
    page = kept.groupBy(*PAGE, "body", "n_rows").agg((F.median("row_size") * 0.8).alias("least"))
    ink = extents.groupBy(*PAGE).agg(F.ceil(F.min("first")).alias("ink_l"), F.floor(F.max("last")).alias("ink_r"))
    # stretches of equal counts within the ink, with what lies before the first and behind the last of them
    flat = occupancy(stretches).join(ink, PAGE).join(page.select(*PAGE, "n_rows"), PAGE)
    flat = flat.select(*PAGE, F.greatest("x", "ink_l").alias("x"), F.least("upto", F.col("ink_r") + 1).alias("upto"), "n", "n_rows").filter("x < upto")
    low = flat.filter(F.col("n") <= F.greatest(F.lit(3.0), F.col("n_rows") * 0.1))
    w = Window.partitionBy(*PAGE).orderBy("x")
    parts = low.withColumn("new", F.when(F.col("x") == F.lag("upto").over(w), 0).otherwise(1)).withColumn("band", F.sum("new").over(w))
    bands = parts.groupBy(*PAGE, "band").agg(F.min("x").alias("low"), F.max("upto").alias("high"), F.collect_list(F.struct("x", "upto", "n")).alias("steps")).join(page, PAGE).filter(F.col("high") - F.col("low") >= F.col("least"))
    mid = (F.col("low") + F.col("high")) / 2
    nearest = lambda s: F.greatest(s["x"], F.least(s["upto"] - 1, F.floor(mid)))
    best = F.array_min(F.transform("steps", lambda s: F.struct((s["n"] * 1000 + F.abs(nearest(s) - mid)).alias("score"), nearest(s).alias("q"))))
    bands = bands.select(*PAGE, "low", "high", best["q"].alias("cut"))
    rows = bands.join(extents.select(*ROW, "first", "last"), PAGE)
    inked = stretches.select(*ROW, F.col("low").alias("s_low"), F.col("high").alias("s_high"))
    across = bands.join(inked, PAGE).filter((F.col("s_low") <= F.col("cut")) & (F.col("s_high") >= F.col("cut"))).select(*ROW, "low", F.lit(True).alias("across")).distinct()
    seen = rows.join(across, [*ROW, "low"], "left").withColumns({"across": F.coalesce("across", F.lit(False)), "l": F.col("first") < F.col("low"), "r": F.col("last") > F.col("high")})
    counted = seen.groupBy(*PAGE, "low", "high", "cut").agg(
        F.count_if("across").alias("n_cross"), F.count_if(~F.col("across") & F.col("l") & F.col("r")).alias("n_split"), F.count_if(~F.col("across") & F.col("l") & ~F.col("r")).alias("n_left"), F.count_if(~F.col("across") & ~F.col("l") & F.col("r")).alias("n_right"),
    )
    good = ((F.col("n_split") >= 3) | ((F.col("n_left") >= 3) & (F.col("n_right") >= 3))) & (F.col("n_cross") <= F.greatest(F.lit(2.0), (F.col("n_split") + F.least("n_left", "n_right")) * 0.5))
    return counted.filter(good).select(*PAGE, "low", "high", "cut", "n_split", "n_cross")


def wide_gaps(glyphs: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, page, row, ci, left, right, mid, w_left, w_right, body): gaps of 1.8 body sizes or more between neighbours of a row, and how wide the
    text is that ends and begins there, up to the next such gap."""
    page = kept.groupBy(*PAGE).agg((F.median("row_size") * 0.8).alias("least"))
    w = Window.partitionBy(*ROW).orderBy("ci")
    rows = glyphs.join(kept.select(*ROW, "body"), ROW).join(page, PAGE).withColumn("before", F.lag("x1").over(w))
    gap = F.col("x0") - F.col("before")
    rows = rows.withColumn("chunk", F.sum(F.when(gap >= F.col("body") * 1.8, 1).otherwise(0)).over(w))
    chunk = Window.partitionBy(*ROW, "chunk")
    rows = rows.withColumns({"c_first": F.min_by("x0", "ci").over(chunk), "c_last": F.max_by("x1", "ci").over(chunk)}).withColumns({"before_first": F.lag("c_first").over(w)})
    found = rows.filter(gap >= F.greatest("least", F.col("body") * 1.8))
    return found.select(*ROW, "ci", F.col("before").alias("left"), F.col("x0").alias("right"), ((F.col("before") + F.col("x0")) / 2).alias("mid"), (F.col("before") - F.col("before_first")).alias("w_left"), (F.col("c_last") - F.col("x0")).alias("w_right"), "body")


def gap_columns(gaps: DataFrame, extents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, page, low, high, cut): wide gaps that three rows or more have at nearly the same place, where no known gutter is.

    A page's gaps are taken from left to right; each joins the last group if it is no further than the body's size from the group's median.
    The gaps' rows are 0.6 or more of those that go on across, and the text at both sides is usually 12 body sizes wide.
    """
    by_page = gaps.groupBy(*PAGE, "body").agg(F.array_sort(F.collect_list(F.struct("mid", "row", "ci", "left", "right", "w_left", "w_right"))).alias("g"))
    mids = F.transform("g", lambda x: x["mid"])
    part = lambda s, k: F.slice(mids, s + 1, k - s)
    starts = F.aggregate(F.sequence(F.lit(0), F.size("g") - 1), F.array(F.lit(0)), lambda s, k: F.when((k > 0) & (F.get(mids, k) - _middle(part(F.element_at(s, -1), k)) > F.col("body")), F.concat(s, F.array(k))).otherwise(s))
    cut_up = by_page.withColumn("s", starts).select(*PAGE, "body", F.explode(F.transform("s", lambda x, i: F.slice("g", x + 1, F.coalesce(F.get("s", i + 1), F.size("g")) - x))).alias("items"))
    of = lambda c: _middle(F.array_sort(F.transform("items", lambda x: x[c])))
    groups = cut_up.select(*PAGE, "body", of("mid").alias("cut"), of("left").alias("low"), of("right").alias("high"), of("w_left").alias("w_left"), of("w_right").alias("w_right"), F.size(F.array_distinct(F.transform("items", lambda x: x["row"]))).alias("n"))
    groups = groups.filter((F.col("n") >= 3) & (F.col("w_left") >= F.col("body") * 12) & (F.col("w_right") >= F.col("body") * 12))
    near = known.select(*PAGE, F.col("cut").alias("k_cut"))
    groups = groups.join(near, (groups.doc_id == near.doc_id) & (groups.page == near.page) & (F.abs(F.col("k_cut") - F.col("cut")) < F.col("body") * 2), "left_anti")
    sides = groups.join(extents, PAGE).groupBy(*PAGE, "cut", "low", "high", "n", "body").agg(
        F.count_if(F.col("x1_min") < F.col("cut")).alias("n_left"), F.count_if(F.col("x0_max") > F.col("cut")).alias("n_right"), F.count_if((F.col("x0_min") < F.col("cut")) & (F.col("x1_max") > F.col("cut"))).alias("n_over"),
    )
    good = sides.filter("n_left >= 3 and n_right >= 3 and n >= n_over * 0.6")
    # from left to right, what stands too near the last one taken is none
    taken = F.aggregate(F.array_sort(F.collect_list(F.struct("cut", "low", "high", "body"))), F.array().cast("array<struct<cut:double,low:double,high:double,body:double>>"), lambda some, x: F.when(F.exists(some, lambda k: F.abs(k["cut"] - x["cut"]) < x["body"] * 2), some).otherwise(F.concat(some, F.array(x))))
    return good.groupBy(*PAGE).agg(taken.alias("taken")).select(*PAGE, F.explode("taken").alias("t")).select(*PAGE, F.least("t.low", "t.cut").alias("low"), F.greatest("t.high", "t.cut").alias("high"), "t.cut")


def find_gutters(glyphs: DataFrame, rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, low, high, cut, n_split, n_cross): where columns part: white bands, and repeated wide gaps (without counts)."""
    # written, as rows, ends and bands are used several times; they are few, and glyphs are gone through once for each of these
    kept = settled(body_rows(rows, pages), "body-rows")
    extents, stretches = settled(_extents(glyphs, kept), "row-ends"), settled(ink_stretches(glyphs, kept), "ink")
    bands = settled(valleys(stretches, extents, kept), "bands")
    more = gap_columns(wide_gaps(glyphs, kept), extents, bands)
    none = F.lit(None).cast("long")
    return bands.select(*PAGE, *(F.col(c).cast("double").alias(c) for c in ("low", "high", "cut")), "n_split", "n_cross").unionByName(more.withColumns({"n_split": none, "n_cross": none}))


def rows_across(glyphs: DataFrame, rows: DataFrame, gutters: DataFrame) -> DataFrame:
    """(doc_id, page, row, cut): rows that go on across a gutter: with ink at its cut, with a gap of less than half a character there, or with large
    letters (1.4 times the body) inside it that stand in the middle of the page's text, or at both sides of the cut."""
    w = Window.partitionBy(*ROW).orderBy("ci")
    body = rows.groupBy(*PAGE).agg(F.median("size").alias("body"))
    span = glyphs.groupBy(*PAGE).agg(((F.min("x0") + F.max("x1")) / 2).alias("middle"))
    met = glyphs.withColumn("after", F.lead("x0").over(w)).join(gutters.select(*PAGE, "low", "high", "cut"), PAGE).join(body, PAGE).join(span, PAGE)
    cut, big = F.col("cut"), F.col("size") >= F.col("body") * 1.4
    inked = (F.col("x0") <= cut) & (F.col("x1") >= cut)
    joined = (F.col("x1") <= cut) & (F.col("after") >= cut) & (F.col("after") - F.col("x1") < F.col("size") * 0.5)
    in_band = big & (F.col("x1") > F.col("low") + 1) & (F.col("x0") < F.col("high") - 1)
    mid = (F.col("x0") + F.col("x1")) / 2
    each = met.groupBy(*ROW, "cut", "middle").agg(
        F.bool_or(inked | F.coalesce(joined, F.lit(False))).alias("at"), F.bool_or(in_band).alias("band"), F.bool_or(big & (mid < cut)).alias("l"), F.bool_or(big & (mid >= cut)).alias("r"),
        F.min_by(F.when(big, F.col("x0")), F.when(big, F.col("ci"))).alias("b0"), F.max_by(F.when(big, F.col("x1")), F.when(big, F.col("ci"))).alias("b1"), F.min_by(F.when(big, F.col("size")), F.when(big, F.col("ci"))).alias("b_size"),
    )
    centred = F.abs((F.col("b0") + F.col("b1")) / 2 - F.col("middle")) < F.col("b_size") * 1.5
    return each.filter(F.col("at") | (F.col("band") & (F.coalesce(centred, F.lit(False)) | (F.col("l") & F.col("r"))))).select(*ROW, "cut")
