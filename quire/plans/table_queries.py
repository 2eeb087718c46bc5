"""Queries of the operators on rules, columns and regions of pages, over shapes and words made from whole documents, and their DuckDB SQL.

A page holds six lines of a document; each line gives a row 40 points high with the rules around it, and its words stand in
that row. Which rules are there, and how long they are, follows from the line's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import gutters, tables
from quire.operators.rounds import dealt_once
from quire.plans.queries import LINES, _lines, query

_ROWS = f"""{LINES}, ln AS (SELECT doc_id, line_no, text, length(text) AS n, CAST(line_no // 6 AS INT) AS page, 20.0::DOUBLE + line_no % 6 * 40 AS top FROM lines),
    glyphs AS (SELECT doc_id, page, line_no, k - 1 AS ci, w[k] AS w, 45.0::DOUBLE + (k - 1) % 13 * 30 AS x0, 45.0::DOUBLE + (k - 1) % 13 * 30 + length(w[k]) * 2 AS x1, top + 6 + (k - 1) // 13 % 3 * 9 AS y0, top + 14 + (k - 1) // 13 % 3 * 9 AS y1, top + 14 + (k - 1) // 13 % 3 * 9 AS oy, 8.0::DOUBLE AS size FROM (SELECT *, string_split(text, ' ') AS w FROM ln) q, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k) r WHERE w[k] <> ''),
    pg AS (SELECT DISTINCT doc_id, page, 480.0::DOUBLE AS page_w, 400.0::DOUBLE AS page_h FROM ln)"""


def _placed(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("n", F.length("text"))
    return rows.select("doc_id", "line_no", "text", "n", F.floor(F.col("line_no") / 6).cast("int").alias("page"), (20.0 + F.col("line_no") % 6 * 40).alias("top"))


def _glyphs(rows: DataFrame) -> DataFrame:
    words = rows.select("doc_id", "page", "line_no", "top", F.posexplode(F.split("text", " ")).alias("ci", "w")).filter("w <> ''")
    x0, y0 = 45.0 + F.col("ci") % 13 * 30, F.col("top") + 6 + F.floor(F.col("ci") / 13) % 3 * 9
    return words.select("doc_id", "page", "line_no", "ci", "w", x0.alias("x0"), (x0 + F.length("w") * 2).alias("x1"), y0.alias("y0"), (y0 + 8).alias("y1"), (y0 + 8).alias("oy"), F.lit(8.0).alias("size"))


def _pages(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "page").distinct().withColumns({"page_w": F.lit(480.0), "page_h": F.lit(400.0)})


#: Of each line: its rule above, up to five upright ones, a ground, a line's box or highlight, and a card.
_SHAPES = f"""{_ROWS}, shapes AS (SELECT *, CASE WHEN n % 11 = 0 THEN [255, 255, 255] WHEN n % 13 = 0 THEN [250, 240, 230] ELSE [n % 90, 0, 0] END AS dark FROM ln),
    paths AS (SELECT doc_id, page, line_no * 16 AS path_id, 40.0 AS x0, top AS y0, CASE WHEN n % 3 <> 0 THEN 440.0 ELSE 240.0 + n % 5 * 10 END AS x1, top + 1 AS y1, NULL::INT[] AS stroke, dark AS fill, 0.0::DOUBLE AS stroke_width FROM shapes
      UNION ALL SELECT doc_id, page, line_no * 16 + 1 + k, 40.0 + 100 * k + CASE WHEN n % 7 = 0 AND k = 2 THEN 2 ELSE 0 END, top + CASE WHEN n % 10 = 0 THEN 9 ELSE 0 END, 41.0 + 100 * k + CASE WHEN n % 7 = 0 AND k = 2 THEN 2 ELSE 0 END, top + 40, NULL, dark, 0.0 FROM shapes, (SELECT unnest(range(0, 5)) AS k) ks WHERE k IN (0, 4) OR (n + k) % 4 <> 0 AND n % 6 <> 5
      UNION ALL SELECT doc_id, page, line_no * 16 + 6, 30.0, top + 2, 450.0, top + 38, NULL, [250, 235, 225], 0.0 FROM shapes WHERE n % 13 = 0
      UNION ALL SELECT doc_id, page, line_no * 16 + 7, 43.0, top + 4, 43.0 + 30 * (1 + n % 5), top + 16, CASE WHEN n % 4 = 1 THEN [0, 0, n % 50] END, CASE WHEN n % 4 <> 1 THEN [255, 240, 0] END, 0.5 FROM shapes WHERE n % 4 < 3
      UNION ALL SELECT doc_id, page, line_no * 16 + 8, 445.0, top + 5, 470.0, top + 30, CASE WHEN n % 2 = 0 THEN [9, 9, 9] END, [200, 200, 200], CASE WHEN n % 6 = 0 THEN 12.0::DOUBLE ELSE 0.5::DOUBLE END FROM shapes WHERE n % 5 = 0)"""


def _paths(rows: DataFrame) -> DataFrame:
    n, top, at = F.col("n"), F.col("top"), F.col("line_no") * 16
    colour = lambda *c: F.array(*(F.lit(x) if isinstance(x, int) else x.cast("int") for x in c))
    dark = F.when(n % 11 == 0, colour(255, 255, 255)).when(n % 13 == 0, colour(250, 240, 230)).otherwise(colour(n % 90, 0, 0))
    no = F.lit(None).cast("array<int>")
    shape = lambda k, x0, y0, x1, y1, stroke, fill, width, when: F.when(when, F.struct((at + k).alias("path_id"), *(F.lit(v).cast("double").alias(c) if not hasattr(v, "cast") else v.cast("double").alias(c) for c, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))), stroke.alias("stroke"), fill.alias("fill"), width.cast("double").alias("stroke_width")))
    zero = F.lit(0.0)
    every = [shape(0, 40.0, top, F.when(n % 3 != 0, 440.0).otherwise(240.0 + n % 5 * 10), top + 1, no, dark, zero, F.lit(True))]
    for k in range(5):
        x = 40.0 + 100 * k + (F.when(n % 7 == 0, 2).otherwise(0) if k == 2 else F.lit(0))
        every.append(shape(1 + k, x, top + F.when(n % 10 == 0, 9).otherwise(0), x + 1, top + 40, no, dark, zero, F.lit(True) if k in (0, 4) else ((n + k) % 4 != 0) & (n % 6 != 5)))
    every.append(shape(6, 30.0, top + 2, 450.0, top + 38, no, colour(250, 235, 225), zero, n % 13 == 0))
    every.append(shape(7, 43.0, top + 4, 43.0 + 30 * (1 + n % 5), top + 16, F.when(n % 4 == 1, colour(0, 0, n % 50)), F.when(n % 4 != 1, colour(255, 240, 0)), F.lit(0.5), n % 4 < 3))
    every.append(shape(8, 445.0, top + 5, 470.0, top + 30, F.when(n % 2 == 0, colour(9, 9, 9)), colour(200, 200, 200), F.when(n % 6 == 0, 12.0).otherwise(0.5), n % 5 == 0))
    return rows.select("doc_id", "page", F.explode(F.filter(F.array(*every), lambda s: s.isNotNull())).alias("s")).select("doc_id", "page", "s.*")


_INK = lambda c: f"coalesce(len(list_filter({c}[1:3], lambda v: v < 245)) > 0, FALSE)"
_FOUND = f"""{_SHAPES}, sh AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0 <= 3 AND y1 - y0 >= 8) OR (y1 - y0 <= 3 AND x1 - x0 >= 8) AS thin FROM paths),
    sp AS (SELECT *, {_INK('stroke')} AND (thin OR stroke_width < least(w, h) * 0.4) AS outline FROM sh), sd AS (SELECT *, CASE WHEN outline THEN stroke[1:3] WHEN thin AND {_INK('fill')} THEN fill[1:3] END AS edge FROM sp),
    gc AS (SELECT doc_id, page, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, oy, size FROM glyphs),
    bi AS (SELECT s.doc_id, s.page, path_id, any_value(h) AS h, any_value(w) AS w, any_value(outline) AS outline, any_value({_INK('fill')}) AS filled, count(*) AS n, median(size) AS size, max(oy) - min(oy) AS spread FROM sd s JOIN gc g ON s.doc_id = g.doc_id AND s.page = g.page AND cx > x0 AND cx < x1 AND cy > y0 AND cy < y1 WHERE w > 8 AND h > 3 GROUP BY ALL),
    bg AS (SELECT doc_id, page, path_id, CASE WHEN outline AND NOT filled AND w > size * 4 AND n >= 2 THEN 'box' ELSE 'highlight' END AS kind FROM bi WHERE h <= size * 2 AND spread < size * 0.5)"""
_RULES = f"""{_FOUND}, use AS (SELECT s.*, page_w, page_h FROM sd s ANTI JOIN bg USING (doc_id, page, path_id) JOIN pg USING (doc_id, page)),
    raw AS (SELECT doc_id, page, path_id * 4 AS seg, TRUE AS up, (x0 + x1) / 2 AS pos, y0 AS low, y1 AS high, edge, FALSE AS shape, x0, y0, x1, y1 FROM use WHERE w <= 3 AND h >= 8
      UNION ALL SELECT doc_id, page, path_id * 4, FALSE, (y0 + y1) / 2, x0, x1, edge, FALSE, x0, y0, x1, y1 FROM use WHERE NOT (w <= 3 AND h >= 8) AND h <= 3 AND w >= 8
      UNION ALL SELECT doc_id, page, path_id * 4 + k, k < 2, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN y0 ELSE y1 END, CASE WHEN k < 2 THEN y0 ELSE x0 END, CASE WHEN k < 2 THEN y1 ELSE x1 END, edge, TRUE, x0, y0, x1, y1 FROM use, (SELECT unnest(range(0, 4)) AS k) ks WHERE w > 8 AND h > 8 AND w < page_w * 0.95 AND h < page_h * 0.95),
    gr AS (SELECT * FROM sd WHERE NOT {_INK('stroke')} AND {_INK('fill')} AND w > 8 AND h > 8),
    segs AS (SELECT r.* REPLACE (CASE WHEN NOT shape AND EXISTS (SELECT 1 FROM gr f WHERE f.doc_id = r.doc_id AND f.page = r.page AND f.x0 - 2 <= CASE WHEN up THEN pos ELSE low END AND f.x1 + 2 >= CASE WHEN up THEN pos ELSE high END AND f.y0 - 2 <= CASE WHEN up THEN low ELSE pos END AND f.y1 + 2 >= CASE WHEN up THEN high ELSE pos END
        AND abs(r.edge[1] - f.fill[1]) + abs(r.edge[2] - f.fill[2]) + abs(r.edge[3] - f.fill[3]) <= 12) THEN NULL ELSE edge END AS edge), CASE WHEN up THEN pos ELSE low END - 1 AS bx0, CASE WHEN up THEN pos ELSE high END + 1 AS bx1, CASE WHEN up THEN low ELSE pos END - 1 AS by0, CASE WHEN up THEN high ELSE pos END + 1 AS by1 FROM raw r),
    touch AS (SELECT a.doc_id, a.page, a.seg AS a, b.seg AS b FROM segs a JOIN segs b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seg <> b.seg AND a.bx0 <= b.bx1 + 2 AND b.bx0 <= a.bx1 + 2 AND a.by0 <= b.by1 + 2 AND b.by0 <= a.by1 + 2),
    reach AS (SELECT doc_id, page, seg AS a, seg AS b FROM segs UNION SELECT r.doc_id, r.page, r.a, t.b FROM reach r JOIN touch t ON r.doc_id = t.doc_id AND r.page = t.page AND r.b = t.a),
    grp AS (SELECT doc_id, page, a AS seg, min(b) AS table_id FROM reach GROUP BY ALL), gs AS (SELECT * FROM segs JOIN grp USING (doc_id, page, seg))"""
_CHAIN = lambda of, keys, v: f"(SELECT {keys}, v FROM (SELECT *, v - lag(v) OVER (PARTITION BY {keys} ORDER BY v) AS step FROM (SELECT DISTINCT {keys}, {v} AS v FROM {of}) d) c WHERE step IS NULL OR step > 3)"
_K = "doc_id, page, table_id"
_TABLES = f"""{_RULES}, ex AS (SELECT {_K}, min(bx0) AS ex0, min(by0) AS ey0, max(bx1) AS ex1, max(by1) AS ey1 FROM gs WHERE edge IS NOT NULL GROUP BY ALL), tw AS (SELECT {_K} FROM {_CHAIN("gs WHERE up AND edge IS NOT NULL", _K, "floor(pos + 0.5)")} GROUP BY ALL HAVING count(*) = 2),
    ks AS (SELECT g.* FROM gs g LEFT JOIN (SELECT * FROM ex JOIN tw USING ({_K})) e USING ({_K}) WHERE NOT coalesce(edge IS NULL AND shape AND (y1 <= ey0 + 3 OR y0 >= ey1 - 3 OR x1 <= ex0 + 3 OR x0 >= ex1 - 3), FALSE)),
    bx AS (SELECT {_K}, min(bx0) AS x0, min(by0) AS y0, max(bx1) AS x1, max(by1) AS y1, avg(CASE WHEN shape THEN 1.0 ELSE 0.0 END) >= 0.8 AS shaped FROM ks GROUP BY ALL), cl AS {_CHAIN("ks WHERE up", _K, "CAST(floor(pos + 0.5) AS BIGINT)")},
    fr AS {_CHAIN(f"(SELECT k.* FROM ks k JOIN (SELECT {_K}, x0 AS lx, x1 AS rx FROM bx) b USING ({_K}) WHERE NOT up AND high - low >= (rx - lx) * 0.9) q", _K, "CAST(floor(pos + 0.5) AS BIGINT)")}, fn AS (SELECT {_K}, count(*) AS n_rules, list(v ORDER BY v) AS ys FROM fr GROUP BY ALL),
    sd2 AS (SELECT {_K}, count(*) AS n_x, bool_and(EXISTS (SELECT 1 FROM ks k WHERE k.doc_id = c.doc_id AND k.page = c.page AND k.table_id = c.table_id AND up AND abs(pos - v) <= 3 AND high - low >= (b.y1 - b.y0) * 0.9)) AS closed, bool_and(EXISTS (SELECT 1 FROM ks k WHERE k.doc_id = c.doc_id AND k.page = c.page AND k.table_id = c.table_id AND up AND abs(pos - v) <= 3 AND edge IS NOT NULL)) AS drawn FROM cl c JOIN bx b USING ({_K}) GROUP BY ALL),
    nr AS (SELECT {_K}, cx > x0 AND cx < x1 AS ins, cx < x0 - 2 OR cx > x1 + 2 AS outs, cx > x0 - 40 AND cx < x1 + 40 AS clo, oy, size FROM bx JOIN gc USING (doc_id, page) WHERE cy > y0 AND cy < y1),
    tx AS (SELECT {_K}, count(*) FILTER (ins) AS n, count(*) FILTER (outs) AS beside, count(*) FILTER (outs AND clo) AS spill, median(size) FILTER (ins) AS size, max(oy) FILTER (ins) - min(oy) FILTER (ins) AS spread FROM nr GROUP BY ALL),
    tl AS (SELECT {_K}, count(*) FILTER (step IS NULL OR step > s * 0.6) AS n_lines FROM (SELECT n.*, oy - lag(oy) OVER (PARTITION BY {_K} ORDER BY oy) AS step FROM nr n WHERE ins) q JOIN (SELECT {_K}, size AS s FROM tx) t USING ({_K}) GROUP BY ALL),
    kn AS (SELECT *, coalesce(n_rules, 0) >= 4 OR (coalesce(n_rules, 0) >= 3 AND coalesce(size, 0) > 0 AND ys[2] - ys[1] <= size * 3) AS rowed, closed AND coalesce(n_rules, 0) = 2 AND coalesce(n_lines, 0) >= 1 AND y1 - y0 < 400 * 0.4 AND x1 - x0 > coalesce(size, 0) * CASE WHEN coalesce(n_lines, 0) >= 2 THEN 8 ELSE 4 END AND drawn AS noted FROM bx JOIN sd2 USING ({_K}) LEFT JOIN fn USING ({_K}) LEFT JOIN tx USING ({_K}) LEFT JOIN tl USING ({_K}) WHERE (SELECT count(*) FROM ks k WHERE k.doc_id = bx.doc_id AND k.page = bx.page AND up) >= 3),
    ft AS (SELECT * FROM kn WHERE (n_x >= 3 OR (n_x = 2 AND (rowed OR noted) AND coalesce(beside, 0) <= coalesce(n, 0) * 0.2)) AND coalesce(n, 0) >= CASE WHEN n_x < 3 THEN 2 ELSE 4 END AND coalesce(spill, 0) <= coalesce(n, 0) * 0.1),
    yy AS {_CHAIN(f"(SELECT {_K}, CAST(floor(pos + 0.5) AS BIGINT) AS y FROM ks JOIN (SELECT {_K} FROM ft) f USING ({_K}) WHERE NOT up UNION ALL SELECT {_K}, CAST(floor(y0 + 1.5) AS BIGINT) FROM ft UNION ALL SELECT {_K}, CAST(floor(y1 - 0.5) AS BIGINT) FROM ft) q", _K, "y")},
    rw AS (SELECT * FROM (SELECT {_K}, row_number() OVER (PARTITION BY {_K} ORDER BY v) - 1 AS "row", v AS y0, lead(v) OVER (PARTITION BY {_K} ORDER BY v) AS y1 FROM yy) q WHERE y1 IS NOT NULL),
    ct AS (SELECT r.doc_id, r.page, r.table_id, "row", v AS x FROM rw r JOIN cl c USING ({_K}) WHERE EXISTS (SELECT 1 FROM ks k WHERE k.doc_id = r.doc_id AND k.page = r.page AND k.table_id = r.table_id AND up AND abs(pos - v) < 3 AND low <= (r.y0 + r.y1) / 2 + 1 AND high >= (r.y0 + r.y1) / 2 - 1)
      UNION ALL SELECT {_K}, "row", CAST(floor(f.x0 + 1.5) AS BIGINT) FROM rw JOIN (SELECT {_K}, x0, x1 FROM ft) f USING ({_K}) UNION ALL SELECT {_K}, "row", CAST(floor(f.x1 - 0.5) AS BIGINT) FROM rw JOIN (SELECT {_K}, x0, x1 FROM ft) f USING ({_K})),
    xx AS {_CHAIN("ct", _K + ', "row"', "x")}, ce AS (SELECT q.*, r.y0, r.y1 FROM (SELECT {_K}, "row", row_number() OVER (PARTITION BY {_K}, "row" ORDER BY v) - 1 AS col, v AS x0, lead(v) OVER (PARTITION BY {_K}, "row" ORDER BY v) AS x1 FROM xx) q JOIN rw r USING ({_K}, "row") WHERE x1 IS NOT NULL),
    fl AS (SELECT {_K}, count(DISTINCT "row" * 10000 + col) AS n_filled FROM ce JOIN gc USING (doc_id, page) WHERE cy >= y0 AND cy < y1 AND cx >= x0 AND cx < x1 GROUP BY ALL),
    tb AS (SELECT f.* FROM ft f JOIN (SELECT {_K}, count(*) AS n_cells FROM ce GROUP BY ALL) c USING ({_K}) LEFT JOIN fl USING ({_K}) WHERE NOT coalesce(shaped AND n_x >= 3 AND coalesce(n_filled, 0) <= 1 AND spread < coalesce(size, 0) * 0.6 AND n_cells >= 2, FALSE))"""


def _shapes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths, centres of glyphs, and pages; a document's lines are dealt out once, and what they give stays there."""
    spark = dealt_once(spark)
    lines = _lines(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    rows = _placed(lines)
    return _paths(rows), tables.centres(_glyphs(rows)), _pages(rows)


@query(f"WITH {_FOUND} SELECT * FROM bg")
def line_backgrounds(spark, sf_dir):
    paths, centres, _ = _shapes(spark, sf_dir)
    return tables.line_backgrounds(paths, centres)


@query(f"WITH RECURSIVE {_RULES} SELECT doc_id, page, seg, table_id, up AS upright, pos AS at, low, high, edge IS NOT NULL AS seen, shape FROM gs")
def rule_groups(spark, sf_dir):
    return tables.rule_groups(*_shapes(spark, sf_dir))


@query(f"""WITH RECURSIVE {_TABLES}, ke AS (SELECT * FROM ce SEMI JOIN tb USING ({_K})), ed AS (SELECT {_K}, list_sort(list_reduce(list_prepend([]::BIGINT[], list_transform(flatten(list([x0, x1] ORDER BY "row", col)), lambda x: [x])), lambda kept, x: CASE WHEN len(list_filter(kept, lambda v: abs(v - x[1]) <= 3)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS e FROM ke GROUP BY ALL),
    pl AS (SELECT k.*, list_position(list_transform(e, lambda v: abs(v - x0) <= 3), TRUE) - 1 AS a, list_position(list_transform(e, lambda v: abs(v - x1) <= 3), TRUE) - 1 AS b, EXISTS (SELECT 1 FROM ks h WHERE h.doc_id = k.doc_id AND h.page = k.page AND h.table_id = k.table_id AND NOT up AND abs(pos - k.y0) <= 2.5 AND low <= (k.x0 + k.x1) / 2 + 1 AND high >= (k.x0 + k.x1) / 2 - 1) AS parted FROM ke k JOIN ed USING ({_K})),
    ru AS (SELECT *, sum(CASE WHEN before = "row" - 1 AND NOT parted THEN 0 ELSE 1 END) OVER (PARTITION BY {_K}, a, b ORDER BY "row") AS run FROM (SELECT *, lag("row") OVER (PARTITION BY {_K}, a, b ORDER BY "row") AS before FROM pl) q)
    SELECT {_K}, CAST(min("row") AS INT) AS "row", CAST(arg_min(col, "row") AS INT) AS col, arg_min(x0, "row") AS x0, min(y0) AS y0, arg_min(x1, "row") AS x1, max(y1) AS y1, CAST(greatest(1, b - a) AS INT) AS colspan, CAST(count(*) AS INT) AS rowspan FROM ru GROUP BY {_K}, a, b, run""")
def page_tables(spark, sf_dir):
    return tables.page_tables(*_shapes(spark, sf_dir))


@query(f"""WITH RECURSIVE {_TABLES}, bo AS (SELECT s.* FROM sd s JOIN bg USING (doc_id, page, path_id) WHERE kind = 'box')
    SELECT doc_id, page, path_id, NOT (EXISTS (SELECT 1 FROM tb t WHERE t.doc_id = bo.doc_id AND t.page = bo.page AND t.x0 < bo.x1 AND bo.x0 < t.x1 AND t.y0 < bo.y1 AND bo.y0 < t.y1) OR EXISTS (SELECT 1 FROM gc g WHERE g.doc_id = bo.doc_id AND g.page = bo.page AND cy > bo.y0 AND cy < bo.y1 AND (cx < bo.x0 - 2 OR cx > bo.x1 + 2))) AS is_table FROM bo""")
def line_box_tables(spark, sf_dir):
    return tables.line_box_tables(*_shapes(spark, sf_dir))


# columns

#: Twelve lines a page. A line's first half stands in the left column, the rest in the right one, which begins later or sooner; some lines go across.
_COLS = f"""{LINES}, lw AS (SELECT doc_id, line_no, length(text) AS n, k - 1 AS ci, w[k] AS w, len(w) AS nw FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM lines) q, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k) r),
    hw AS (SELECT *, CASE WHEN n % 7 = 0 OR ci * 2 < nw THEN 0 ELSE 1 END AS half FROM lw), ow AS (SELECT *, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id, line_no, half ORDER BY ci) AS BIGINT) - length(w) - 1 AS off, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id, line_no, half) AS BIGINT) AS total FROM hw),
    sc AS (SELECT *, CASE WHEN n % 7 = 0 THEN 420.0::DOUBLE ELSE 190.0::DOUBLE + n % 3 * 5 + CASE WHEN (line_no // 12 + doc_id) % 3 = 2 THEN n * 7 % 30 ELSE 0 END END / total AS s, CASE WHEN half = 0 THEN 40.0::DOUBLE ELSE 262.0::DOUBLE + CASE WHEN (line_no // 12 + doc_id) % 3 = 2 THEN n * 7 % 30 ELSE n % 4 * 3 END END AS origin, CASE WHEN n % 13 = 0 THEN 15.0::DOUBLE ELSE 10.0::DOUBLE END AS size FROM ow),
    gl AS (SELECT doc_id, CAST(line_no // 12 AS INT) AS page, line_no AS "row", ci, origin + off * s AS x0, origin + (off + length(w)) * s AS x1, size FROM sc), rr AS (SELECT doc_id, CAST(line_no // 12 AS INT) AS page, line_no AS "row", 12.0::DOUBLE + line_no % 12 * 18 AS oy, CASE WHEN length(text) % 13 = 0 THEN 15.0::DOUBLE ELSE 10.0::DOUBLE END AS size FROM lines WHERE trim(text, ' ') <> '')"""


def _columned(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    n, at = F.col("n"), F.col("line_no")
    # documents stay together, so running sums and neighbours in lines, and what words meet, need no shuffle of words; a fixed number, or little text would end in one task
    spark = dealt_once(spark)
    lines = _lines(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").withColumn("n", F.length("text")).withColumn("w", F.filter(F.split("text", " "), lambda x: x != ""))
    size, page = F.when(n % 13 == 0, 15.0).otherwise(10.0), F.floor(at / 12).cast("int")
    words = lines.select("doc_id", "line_no", "n", F.size("w").alias("nw"), F.posexplode("w").alias("ci", "w")).withColumn("half", F.when((n % 7 == 0) | (F.col("ci") * 2 < F.col("nw")), 0).otherwise(1))
    half = Window.partitionBy("doc_id", "line_no", "half")
    words = words.withColumn("off", F.sum(F.length("w") + 1).over(half.orderBy("ci")) - F.length("w") - 1).withColumn("total", F.sum(F.length("w") + 1).over(half))
    s = F.when(n % 7 == 0, 420.0).otherwise(190.0 + n % 3 * 5 + F.when((F.floor(at / 12) + F.col("doc_id")) % 3 == 2, n * 7 % 30).otherwise(0)) / F.col("total")
    origin = F.when(F.col("half") == 0, 40.0).otherwise(262.0 + F.when((F.floor(at / 12) + F.col("doc_id")) % 3 == 2, n * 7 % 30).otherwise(n % 4 * 3))
    glyphs = words.select("doc_id", page.alias("page"), at.alias("row"), "ci", (origin + F.col("off") * s).alias("x0"), (origin + (F.col("off") + F.length("w")) * s).alias("x1"), size.alias("size"))
    rows = lines.filter(F.size("w") > 0).select("doc_id", page.alias("page"), at.alias("row"), (12.0 + at % 12 * 18).alias("oy"), size.alias("size"))
    return glyphs, rows, rows.select("doc_id", "page").distinct().withColumns({"page_w": F.lit(500.0), "page_h": F.lit(230.0)})


_GUTTERS = f"""{_COLS}, bs AS (SELECT doc_id, page, median(size) AS body FROM rr GROUP BY ALL), kr AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n_rows FROM rr JOIN bs USING (doc_id, page) WHERE NOT ((oy < 230 * 0.07 OR oy > 230 * 0.93) AND size < body * 1.2) AND size >= body * 0.75), kp AS (SELECT * FROM kr WHERE n_rows >= 6),
    kg AS (SELECT g.*, body, n_rows, lead(x0) OVER w AS nx, lag(x1) OVER w AS px FROM gl g JOIN (SELECT doc_id, page, "row", body, n_rows FROM kp) k USING (doc_id, page, "row") WINDOW w AS (PARTITION BY doc_id, page, "row" ORDER BY ci)),
    mk AS (SELECT DISTINCT doc_id, page, "row", x FROM (SELECT doc_id, page, "row", unnest(range(greatest(0, CAST(floor(x0) AS BIGINT)), least(500, CAST(ceil(CASE WHEN nx - x1 < size THEN nx ELSE x1 END) AS BIGINT)) + 1)) AS x FROM kg) q), oc AS (SELECT doc_id, page, x, count(*) AS n FROM mk GROUP BY ALL),
    ext AS (SELECT doc_id, page, "row", arg_min(x0, ci) AS f, arg_max(x1, ci) AS l FROM kg GROUP BY ALL), ink AS (SELECT doc_id, page, CAST(ceil(min(f)) AS BIGINT) AS il, CAST(floor(max(l)) AS BIGINT) AS ir FROM ext GROUP BY ALL), pp AS (SELECT doc_id, page, any_value(body) AS body, any_value(n_rows) AS n_rows, median(size) * 0.8 AS least FROM kp GROUP BY ALL),
    xs AS (SELECT q.doc_id, q.page, q.x, coalesce(n, 0) AS n, n_rows, least FROM (SELECT *, unnest(range(il, ir + 1)) AS x FROM ink JOIN pp USING (doc_id, page)) q LEFT JOIN oc USING (doc_id, page, x)), lo AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, page ORDER BY x) AS isle FROM xs WHERE n <= greatest(3, n_rows * 0.1)),
    bd AS (SELECT doc_id, page, min(x) AS low, max(x) + 1 AS high, arg_min(x, (n * 1000 + abs(x - m), x)) AS cut FROM (SELECT *, (min(x) OVER i + max(x) OVER i + 1) / 2.0 AS m FROM lo WINDOW i AS (PARTITION BY doc_id, page, isle)) q GROUP BY doc_id, page, isle, m HAVING max(x) + 1 - min(x) >= any_value(least)),
    ck AS (SELECT b.doc_id, b.page, low, high, cut, EXISTS (SELECT 1 FROM mk m WHERE m.doc_id = b.doc_id AND m.page = b.page AND m."row" = e."row" AND m.x = b.cut) AS crs, f < low AS hl, l > high AS hr FROM bd b JOIN ext e ON b.doc_id = e.doc_id AND b.page = e.page),
    va AS (SELECT doc_id, page, low, high, cut, count(*) FILTER (NOT crs AND hl AND hr) AS n_split, count(*) FILTER (crs) AS n_cross FROM ck GROUP BY ALL HAVING (count(*) FILTER (NOT crs AND hl AND hr) >= 3 OR (count(*) FILTER (NOT crs AND hl AND NOT hr) >= 3 AND count(*) FILTER (NOT crs AND NOT hl AND hr) >= 3)) AND count(*) FILTER (crs) <= greatest(2, (count(*) FILTER (NOT crs AND hl AND hr) + least(count(*) FILTER (NOT crs AND hl AND NOT hr), count(*) FILTER (NOT crs AND NOT hl AND hr))) * 0.5)),
    ch AS (SELECT *, sum(CASE WHEN x0 - px >= body * 1.8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, "row" ORDER BY ci) AS chunk FROM kg), cx AS (SELECT *, arg_min(x0, ci) OVER c AS c0, arg_max(x1, ci) OVER c AS c1 FROM ch WINDOW c AS (PARTITION BY doc_id, page, "row", chunk)),
    gp AS (SELECT q.*, px AS gleft, x0 AS gright, (px + x0) / 2 AS mid, px - pc0 AS wl, c1 - x0 AS wr, row_number() OVER (PARTITION BY doc_id, page ORDER BY (px + x0) / 2, "row", ci) AS i FROM (SELECT *, lag(c0) OVER (PARTITION BY doc_id, page, "row" ORDER BY ci) AS pc0 FROM cx) q JOIN (SELECT doc_id, page, least FROM pp) p USING (doc_id, page) WHERE x0 - px >= greatest(least, body * 1.8)),
    fo AS (SELECT doc_id, page, i, mid, [mid] AS held, 1 AS g FROM gp WHERE i = 1 UNION ALL SELECT p.doc_id, p.page, p.i, p.mid, CASE WHEN p.mid - list_median(f.held) <= p.body THEN list_append(f.held, p.mid) ELSE [p.mid] END, f.g + CASE WHEN p.mid - list_median(f.held) <= p.body THEN 0 ELSE 1 END FROM fo f JOIN gp p ON p.doc_id = f.doc_id AND p.page = f.page AND p.i = f.i + 1),
    gg AS (SELECT doc_id, page, g, any_value(body) AS body, median(gp.mid) AS cut, median(gleft) AS low, median(gright) AS high, median(wl) AS wl, median(wr) AS wr, count(DISTINCT "row") AS n FROM gp JOIN fo USING (doc_id, page, i) GROUP BY doc_id, page, g),
    en AS (SELECT doc_id, page, "row", min(x0) AS a0, max(x0) AS a1, min(x1) AS b0, max(x1) AS b1 FROM kg GROUP BY ALL),
    ok AS (SELECT g.doc_id, g.page, cut, low, high, body, row_number() OVER (PARTITION BY g.doc_id, g.page ORDER BY cut) AS i FROM gg g JOIN en e ON e.doc_id = g.doc_id AND e.page = g.page WHERE n >= 3 AND wl >= body * 12 AND wr >= body * 12 AND NOT EXISTS (SELECT 1 FROM va WHERE va.doc_id = g.doc_id AND va.page = g.page AND abs(va.cut - g.cut) < g.body * 2) GROUP BY g.doc_id, g.page, cut, low, high, body, n HAVING count(*) FILTER (b0 < cut) >= 3 AND count(*) FILTER (a1 > cut) >= 3 AND n >= count(*) FILTER (a0 < cut AND b1 > cut) * 0.6),
    tk AS (SELECT doc_id, page, i, cut, low, high, TRUE AS good, [cut] AS held FROM ok WHERE i = 1 UNION ALL SELECT o.doc_id, o.page, o.i, o.cut, o.low, o.high, len(list_filter(t.held, lambda c: abs(c - o.cut) < o.body * 2)) = 0, CASE WHEN len(list_filter(t.held, lambda c: abs(c - o.cut) < o.body * 2)) = 0 THEN list_append(t.held, o.cut) ELSE t.held END FROM tk t JOIN ok o ON o.doc_id = t.doc_id AND o.page = t.page AND o.i = t.i + 1),
    gu AS (SELECT doc_id, page, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CAST(cut AS DOUBLE) AS cut, n_split, n_cross FROM va UNION ALL SELECT doc_id, page, least(low, cut), greatest(high, cut), cut, NULL, NULL FROM tk WHERE good)"""


@query(f"WITH RECURSIVE {_GUTTERS} SELECT * FROM gu")
def page_gutters(spark, sf_dir):
    return gutters.find_gutters(*_columned(spark, sf_dir))


@query(f"""WITH RECURSIVE {_GUTTERS}, ms AS (SELECT doc_id, page, (min(x0) + max(x1)) / 2 AS middle FROM gl GROUP BY ALL), al AS (SELECT g.*, lead(x0) OVER (PARTITION BY g.doc_id, g.page, "row" ORDER BY ci) AS nx, body, middle, size >= body * 1.4 AS big FROM gl g JOIN bs USING (doc_id, page) JOIN ms USING (doc_id, page)),
    me AS (SELECT a.doc_id, a.page, "row", u.cut, middle, bool_or((x0 <= u.cut AND x1 >= u.cut) OR coalesce(x1 <= u.cut AND nx >= u.cut AND nx - x1 < size * 0.5, FALSE)) AS hit, bool_or(big AND x1 > u.low + 1 AND x0 < u.high - 1) AS band, bool_or(big AND (x0 + x1) / 2 < u.cut) AS l, bool_or(big AND (x0 + x1) / 2 >= u.cut) AS r,
        arg_min(x0, ci) FILTER (big) AS b0, arg_max(x1, ci) FILTER (big) AS b1, arg_min(size, ci) FILTER (big) AS bsz FROM al a JOIN gu u ON a.doc_id = u.doc_id AND a.page = u.page GROUP BY ALL)
    SELECT doc_id, page, "row", cut FROM me WHERE hit OR (band AND (coalesce(abs((b0 + b1) / 2 - middle) < bsz * 1.5, FALSE) OR (l AND r)))""")
def rows_across(spark, sf_dir):
    glyphs, rows, pages = _columned(spark, sf_dir)
    return gutters.rows_across(glyphs, rows, gutters.find_gutters(glyphs, rows, pages))
