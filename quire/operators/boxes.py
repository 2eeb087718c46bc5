"""Greedy steps on the boxes of one page, whose outcome depends on the order of visits: one small group each.

A page's boxes are few whatever the corpus holds, so a group stays small; Spark deals the pages out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGE = ["doc_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]


def _area(a: list | tuple) -> float:
    return max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1])


def _shared(a: list | tuple, b: list | tuple) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def per_page(rows: DataFrame, columns: list[str], work: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """(doc_id, page, schema): work() on each page's rows, as tuples of columns, sorted by these. Pages come by the batch: most of the
    time of a group of pandas of its own goes to making it, and pages are many and small. They are dealt out over all parts, as
    their rows take more time than their size tells."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = F.sort_array(F.collect_list(F.struct(*columns)))
    gathered = rows.repartition(n, *PAGE).groupBy(*PAGE).agg(items.alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(full)
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            rows_ = list(zip(*(f.to_pylist() for f in flat.flatten())))
            out: list[list] = [[] for _ in target]
            for d, g, a, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends - ends[0], ends[1:] - ends[0]):
                for r in work(rows_[a:z]):
                    for c, v in zip(out, (d, g, *r)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, target)], schema=target)

    full = StructType([gathered.schema[c] for c in PAGE] + StructType.fromDDL(schema).fields)
    return gathered.mapInArrow(run, full)


def suppressed(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, page, box_id): boxes (score, x0..y1) kept from the highest score down, ties by id, unless a kept one
    shares at least `share` of the smaller of both."""

    def work(rows: list[tuple]) -> Iterator[tuple]:
        kept: list[tuple] = []
        for _, i, *b in rows:
            if all(_shared(b, k) < share * max(min(_area(b), _area(k)), 1e-9) for k in kept):
                kept.append(b)
                yield (i,)

    return per_page(boxes.select(*PAGE, (-F.col("score")).alias("least"), "box_id", *BOX), ["least", "box_id", *BOX], work, "box_id long")


def touching_groups(boxes: DataFrame, reach: float = 2.0) -> DataFrame:
    """(doc_id, page, box_id, group_id): boxes that touch within `reach`, over any number of others; by the smallest id."""

    def work(rows: list[tuple]) -> Iterator[tuple]:
        return ((rows[i][0], rows[g][0]) for i, g in enumerate(touching([r[1:] for r in rows], reach)))

    return per_page(boxes.select(*PAGE, "box_id", *(F.col(c).cast("double").alias(c) for c in BOX)), ["box_id", *BOX], work, "box_id long, group_id long")


def touching(boxes: list[tuple], reach: float) -> list[int]:
    """For each box (x0, y0, x1, y1) the first one of those that it touches within `reach`, over any number of others. Boxes are taken from
    left to right, each with those alone that still reach so far."""
    parent = list(range(len(boxes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(boxes) < 64:
        for i, (x0, y0, x1, y1) in enumerate(boxes):
            for j in range(i):
                a, b, c, d = boxes[j]
                if a <= x1 + reach and c >= x0 - reach and b <= y1 + reach and d >= y0 - reach:
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    else:
        b = np.array(boxes, float)
        order = np.argsort(b[:, 0], kind="stable")
        active = np.empty(0, int)
        for i in order:
            active = active[b[active, 2] >= b[i, 0] - reach]
            for j in active[(b[active, 1] <= b[i, 3] + reach) & (b[active, 3] >= b[i, 1] - reach)]:
                x, y = sorted((root(int(i)), root(int(j))))
                parent[y] = x
            active = np.append(active, i)
    return [root(i) for i in range(len(boxes))]


def grown_boxes(boxes: DataFrame, pad: float = 0.0) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1, n): boxes that meet become the box around both, until none meet."""

    def work(rows: list[tuple]) -> list[tuple]:
        todo, done = [(*r[1:], 1) for r in reversed(rows)], []
        while todo:
            x0, y0, x1, y1, n = todo.pop()
            hit = next((k for k, (a, b, c, d, _) in enumerate(done) if a <= x1 + pad and c >= x0 - pad and b <= y1 + pad and d >= y0 - pad), None)
            if hit is None:
                done.append((x0, y0, x1, y1, n))
            else:
                a, b, c, d, m = done.pop(hit)
                todo.append((min(a, x0), min(b, y0), max(c, x1), max(d, y1), n + m))
        return done

    return per_page(boxes.select(*PAGE, "box_id", *(F.col(c).cast("double").alias(c) for c in BOX)), ["box_id", *BOX], work, "x0 double, y0 double, x1 double, y1 double, n int")


def anchored_rows(glyphs: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, page, ci, row_no): glyphs (ci, oy, size) by baseline, a row holding those within `share` of the size of its
    first glyph; the first counts, not the one before."""

    def work(rows: list[tuple]) -> Iterator[tuple]:
        row, anchor = -1, None
        for oy, ci, size in rows:
            if anchor is None or oy - anchor > share * size:
                row, anchor = row + 1, oy
            yield ci, row

    return per_page(glyphs, ["oy", "ci", "size"], work, "ci long, row_no int")


def gap_columns(words: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """(doc_id, page, column, x, n): left edges (x0, h, line_no) that lie within `share` of the height of their group's
    running mean, in at least `least` different lines."""

    def work(rows: list[tuple]) -> Iterator[tuple]:
        found: list[list] = []
        for x, line, h in rows:
            if found and abs(x - found[-1][0]) <= share * h:
                g = found[-1]
                g[1] += 1
                g[0] += (x - g[0]) / g[1]
                g[2].add(line)
            else:
                found.append([x, 1, {line}])
        good = [g for g in found if len(g[2]) >= least]
        return ((i, g[0], g[1]) for i, g in enumerate(good))

    return per_page(words.withColumn("x0", F.col("x0").cast("double")), ["x0", "line_no", "h"], work, "column int, x double, n int")


def table_grid(cells: DataFrame) -> DataFrame:
    """cells (doc_id, page, row, cell_no, colspan, rowspan) with col: the first free column of the row, spans kept free."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows, taken, cols = rows.sort_values(["row", "cell_no"]), set(), []
        for r, w, h in zip(rows["row"], rows["colspan"], rows["rowspan"]):
            c = 0
            while (r, c) in taken:
                c += 1
            taken |= {(r + i, c + j) for i in range(max(1, h)) for j in range(max(1, w))}
            cols.append(c)
        return rows[["doc_id", "page", "row", "cell_no", "colspan", "rowspan"]].assign(col=cols)

    return cells.groupBy(*PAGE).applyInPandas(work, "doc_id long, page int, row int, cell_no int, colspan int, rowspan int, col int")
