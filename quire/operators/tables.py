"""Tables drawn with rules: segments from shapes, groups of touching segments, rows and cells of each group, spans.

paths: (doc_id, page, path_id, x0, y0, x1, y1, stroke, fill, stroke_width), colours as arrays of three numbers up to 255, or null;
glyphs: (doc_id, page, x0, y0, x1, y1, oy, size) of what isn't white space, or their centres; pages: (doc_id, page, page_w, page_h).

A page's shapes and centres come to one place, pages by the batch, and rules.py works on all pages of a batch at once: a join for each of its steps would
take most of the time of pages that are many and small. What meets on a page is looked for piece by piece, so pages with very many rules need no more memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.operators import rules

PAGE = ["doc_id", "page"]
#: So many shapes and centres are worked on at once, or one page.
AT_ONCE = 200_000


def has_ink(colour: Column) -> Column:
    """Whether a colour is there and not nearly white."""
    return F.coalesce(F.exists(F.slice(colour, 1, 3), lambda v: v < 245), F.lit(False))


def _shaped(paths: DataFrame) -> DataFrame:
    """paths with their size and the colour of the edge that is seen: a stroke that isn't as broad as the shape itself, or what a thin shape is filled with."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    thin = ((w <= 3) & (h >= 8)) | ((h <= 3) & (w >= 8))
    band = ~thin & (F.coalesce("stroke_width", F.lit(0.0)) >= F.least(w, h) * 0.4)
    outline = has_ink(F.col("stroke")) & ~band
    edge = F.when(outline, F.slice("stroke", 1, 3)).when(thin & has_ink(F.col("fill")), F.slice("fill", 1, 3))
    return paths.withColumns({"w": w, "h": h, "outline": outline, "edge": edge})


def centres(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, cx, cy, g_oy, g_size, k): where glyphs have their centres, and how many are alike there; centres stay as they are."""
    if "cx" in glyphs.columns:
        return glyphs
    at = [((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.col("oy").alias("g_oy"), F.col("size").alias("g_size")]
    return glyphs.groupBy(*PAGE, *at).agg(F.count("*").alias("k"))


def line_backgrounds(paths: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, path_id, kind): shapes no higher than two lines around a single line of text. kind: box where they are drawn
    as an outline around two characters or more, and wider than four of them; else highlight."""
    shapes = _shaped(paths).filter("w > 8 and h > 3")
    inside = (F.col("cx") > F.col("x0")) & (F.col("cx") < F.col("x1")) & (F.col("cy") > F.col("y0")) & (F.col("cy") < F.col("y1"))
    held = shapes.join(centres(glyphs), PAGE).filter(inside).groupBy(*PAGE, "path_id").agg(F.sum("k").alias("n"), F.percentile("g_size", 0.5, F.col("k")).alias("size"), (F.max("g_oy") - F.min("g_oy")).alias("spread"))
    one = shapes.join(held, [*PAGE, "path_id"]).filter((F.col("h") <= F.col("size") * 2) & (F.col("spread") < F.col("size") * 0.5))
    box = F.col("outline") & ~has_ink(F.col("fill")) & (F.col("w") > F.col("size") * 4) & (F.col("n") >= 2)
    return one.select(*PAGE, "path_id", F.when(box, "box").otherwise("highlight").alias("kind"))


def _flat(lists: pa.Array) -> pd.DataFrame:
    """The structs of lists, one row each, with pg, the place of their list."""
    flat = lists.flatten()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pd.DataFrame({"pg": np.repeat(np.arange(len(lists)), n)} | {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)})


def _by_pages(paths: DataFrame, glyphs: DataFrame, pages: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """(doc_id, page, schema): work() on the shapes, centres and sizes of some pages, which gives rows with pg, the page's number."""
    three = lambda of, to: [F.get(of, k).cast("double").alias(f"{to}{k}") for k in range(3)]
    shapes = _shaped(paths).select(*PAGE, F.struct("path_id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "w", "h")), "outline", F.col("edge").isNotNull().alias("seen"), has_ink(F.col("stroke")).alias("stroked"), has_ink(F.col("fill")).alias("filled"), *three("edge", "c"), *three("fill", "f")).alias("s"))
    ink = centres(glyphs).select(*PAGE, F.struct("cx", "cy", F.col("g_oy").cast("double").alias("oy"), F.col("g_size").cast("double").alias("size"), "k").alias("s"))
    each = shapes.groupBy(*PAGE).agg(F.collect_list("s").alias("paths")).join(pages.select(*PAGE, "page_w", "page_h"), PAGE).join(ink.groupBy(*PAGE).agg(F.collect_list("s").alias("ink")), PAGE, "left")
    each = each.select(*PAGE, "page_w", "page_h", "paths", "ink")
    full = StructType([each.schema[c] for c in PAGE] + StructType.fromDDL(schema).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(full)
        for batch in batches:
            load = sum(pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (4, 5))
            part = np.cumsum(load) // AT_ONCE
            ends = np.flatnonzero(np.diff(part, append=part[-1:] + 1)) + 1
            for a, z in zip([0, *ends[:-1]], ends):
                some = batch.slice(a, z - a)
                out = work(_flat(some.column(4)), _flat(some.column(5)), pd.DataFrame({c: some.column(k).to_numpy(zero_copy_only=False) for k, c in ((2, "page_w"), (3, "page_h"))}))
                at = pa.array(out["pg"].to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([some.column(k).take(at) for k in (0, 1)] + [pa.array(out[f.name].to_numpy()).cast(f.type) for f in list(target)[2:]], schema=target)

    return each.mapInArrow(run, full)


def rule_groups(paths: DataFrame, glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, seg, table_id, upright, at, low, high, seen, shape): thin shapes as segments, and the four sides of others that leave some of the page free,
    without backgrounds of single lines. shape: whether it is the side of a shape; seen: whether its edge has a colour that its ground doesn't have;
    table_id: the smallest segment that it touches, to within 2 points, over any number of others."""

    def work(paths: pd.DataFrame, ink: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        return rules.groups(rules.segments(rules.backgrounds(paths, ink), page))

    return _by_pages(paths, glyphs, pages, work, "seg long, table_id long, upright boolean, at double, low double, high double, seen boolean, shape boolean")


def line_box_tables(paths: DataFrame, glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, path_id, is_table): boxes around one line: tables of one cell, unless they meet a ruled table or text stands beside them."""

    def work(paths: pd.DataFrame, ink: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        paths = rules.backgrounds(paths, ink)
        found, _, _ = rules.ruled(rules.groups(rules.segments(paths, page)), ink, page)
        return rules.one_cells(paths, found, ink)

    return _by_pages(paths, glyphs, pages, work, f"path_id {paths.schema['path_id'].dataType.simpleString()}, is_table boolean")


def page_tables(paths: DataFrame, glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, table_id, row, col, x0, y0, x1, y1, colspan, rowspan): the cells of all ruled tables of all pages."""

    def work(paths: pd.DataFrame, ink: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        grouped = rules.groups(rules.segments(rules.backgrounds(paths, ink), page))
        _, segs, cells = rules.ruled(grouped, ink, page)
        out, first = rules.spanned(cells, segs), grouped.drop_duplicates("g").set_index("g")
        return out.assign(pg=first["pg"].reindex(out["g"]).to_numpy(), table_id=first["table_id"].reindex(out["g"]).to_numpy())

    return _by_pages(paths, glyphs, pages, work, "table_id long, row int, col int, x0 long, y0 long, x1 long, y1 long, colspan int, rowspan int")
