"""Queries of the page-level operators, over lines with varied geometry made from whole documents, and their DuckDB SQL.

Lines stand on pages of six; sizes, edges, weights and angles follow from the lines' lengths, figures stand at longer lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions import scalars as S
from quire.operators import lines, pages
from quire.plans.queries import LINES, NORM, _lines, query, table

GEO = f"""{LINES}, geo AS (SELECT doc_id, CAST(line_no // 6 AS INT) AS page, line_no, text, n, CAST(8 + n % 4 AS DOUBLE) AS size, CAST(36 + n % 3 * 12 AS DOUBLE) AS x0, CAST(36 + n % 3 * 12 AS DOUBLE) + n * CAST(8 + n % 4 AS DOUBLE) / 2 AS x1, CAST(20 + line_no % 6 * 53 + n % 5 AS DOUBLE) AS oy,
    CAST(480 AS DOUBLE) AS page_w, CAST(320 AS DOUBLE) AS page_h, CASE WHEN n % 7 = 0 THEN 700 ELSE 400 END AS weight, CAST(CASE WHEN n % 11 = 0 THEN 0.5 WHEN n % 13 = 0 THEN 0.1 ELSE 0 END AS DOUBLE) AS angle FROM (SELECT *, length(text) AS n FROM lines) l),
    figs AS (SELECT doc_id, page, line_no AS box_id, line_no AS seq, CAST(20 + n % 5 * 30 AS DOUBLE) AS x0, oy - 30 AS y0, CAST(20 + n % 5 * 30 + n * 2 AS DOUBLE) AS x1, oy + 10 + n % 40 AS y1, n % 3 = 0 AS has_alpha, page_w, page_h, n, CASE n % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'chart' WHEN 2 THEN 'header' ELSE 'footer' END AS label, n % 10 / 10.0 AS score FROM geo)"""


def _geo(spark, sf_dir) -> DataFrame:
    n = F.col("n")
    rows = _lines(spark, sf_dir).withColumn("n", F.length("text")).select("doc_id", F.floor(F.col("line_no") / 6).cast("int").alias("page"), "line_no", "text", "n", (8.0 + n % 4).alias("size"), (36.0 + n % 3 * 12).alias("x0"))
    return rows.select(
        "*", (F.col("x0") + n * F.col("size") / 2).alias("x1"), (20.0 + F.col("line_no") % 6 * 53 + n % 5).alias("oy"), F.lit(480.0).alias("page_w"), F.lit(320.0).alias("page_h"),
        F.when(n % 7 == 0, 700).otherwise(400).alias("weight"), F.when(n % 11 == 0, 0.5).when(n % 13 == 0, 0.1).otherwise(0.0).alias("angle"),
    )


def _figs(spark, sf_dir) -> DataFrame:
    n, x0 = F.col("n"), 20.0 + F.col("n") % 5 * 30
    label = F.get(F.array(*map(F.lit, ("image", "chart", "header", "footer"))), n % 4)
    return _geo(spark, sf_dir).select("doc_id", "page", F.col("line_no").alias("box_id"), F.col("line_no").alias("seq"), x0.alias("x0"), (F.col("oy") - 30).alias("y0"), (x0 + n * 2).alias("x1"), (F.col("oy") + 10 + n % 40).alias("y1"), (n % 3 == 0).alias("has_alpha"), "page_w", "page_h", "n", label.alias("label"), (n % 10 / 10.0).alias("score"))


# filters


@query(f"""WITH {GEO}, r AS (SELECT *, (x0 + x1) / 2 AS x, oy - size / 2 AS y FROM geo), c AS (SELECT * FROM figs WHERE NOT has_alpha AND greatest(0, least(page_w, x1) - greatest(0, x0)) * greatest(0, least(page_h, y1) - greatest(0, y0)) >= 0.1 * page_w * page_h)
    SELECT doc_id, line_no FROM r WHERE x BETWEEN 0 AND page_w AND y BETWEEN 0 AND page_h AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = r.doc_id AND c.page = r.page AND c.seq > r.line_no AND r.x > c.x0 AND r.x < c.x1 AND r.y > c.y0 AND r.y < c.y1)""")
def visible_lines(spark, sf_dir):
    rows = _geo(spark, sf_dir).withColumns({"seq": F.col("line_no"), "y0": F.col("oy") - F.col("size"), "y1": F.col("oy")})
    return pages.visible(rows, _figs(spark, sf_dir), share=0.1).select("doc_id", "line_no")


@query(f"WITH {GEO} SELECT doc_id, line_no, CASE WHEN n % 17 = 0 OR angle > 0.02 THEN 'graphic' ELSE 'text' END AS kind, angle < 0.3 AS upright FROM geo")
def set_kinds(spark, sf_dir):
    angle = F.col("angle") - F.when(F.col("n") % 2 == 0, F.lit(2 * 3.141592653589793)).otherwise(0.0)
    return _geo(spark, sf_dir).select("doc_id", "line_no", pages.set_kind(angle, F.col("n") % 17 == 0).alias("kind"), pages.is_upright(angle).alias("upright"))


@query(f"""WITH {GEO}, p AS (SELECT doc_id, page, sum(n) % 60 AS n_chars FROM geo GROUP BY ALL), a AS (SELECT doc_id, page, sum(greatest(0, least(page_w, x1) - greatest(0, x0)) * greatest(0, least(page_h, y1) - greatest(0, y0))) AS area FROM figs GROUP BY ALL)
    SELECT doc_id, bool_and(n_chars <= 48 AND coalesce(area, 0) >= 480 * 320 * 0.2) AS raster_only FROM p LEFT JOIN a USING (doc_id, page) GROUP BY doc_id""")
def raster_documents(spark, sf_dir):
    w, h = F.least("page_w", "x1") - F.greatest(F.lit(0.0), "x0"), F.least("page_h", "y1") - F.greatest(F.lit(0.0), "y0")
    area = _figs(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)).alias("raster_area"))
    chars = _geo(spark, sf_dir).groupBy("doc_id", "page", "page_w", "page_h").agg((F.sum("n") % 60).alias("n_chars"))
    return pages.raster_documents(chars.join(area, ["doc_id", "page"], "left").fillna(0.0, ["raster_area"]), share=0.2)


#: Every second page begins with the document's first line and a number; every third page's lines are those of the page two before it.
_NOTED = """noted AS (SELECT * REPLACE (CASE WHEN line_no % 6 = 0 AND page % 2 = 0 THEN first_value(text) OVER (PARTITION BY doc_id ORDER BY line_no) || ' ' || page WHEN page % 3 = 2 THEN lag(text, 12) OVER (PARTITION BY doc_id ORDER BY line_no) ELSE text END AS text) FROM geo),
    body_l AS (SELECT * FROM noted WHERE length(text) >= 4 AND oy BETWEEN page_h * 0.12 AND page_h * 0.88),
    dups AS (SELECT a.doc_id, a.page AS page_a, b.page AS page_b FROM body_l a JOIN body_l b ON a.doc_id = b.doc_id AND a.text = b.text AND a.page < b.page AND abs(a.oy - b.oy) < 8 GROUP BY ALL HAVING count(DISTINCT a.line_no) >= 3)"""


def _noted(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line_no")
    head = (F.col("line_no") % 6 == 0) & (F.col("page") % 2 == 0)
    return _geo(spark, sf_dir).withColumn("text", F.when(head, F.concat(F.first("text").over(w), F.lit(" "), "page")).when(F.col("page") % 3 == 2, F.lag("text", 12).over(w)).otherwise(F.col("text")))


@query(f"WITH {GEO}, {_NOTED} SELECT * FROM dups")
def duplicate_pages(spark, sf_dir):
    return lines.duplicate_pages(_noted(spark, sf_dir))


@query(f"""WITH {GEO}, {_NOTED}, e AS (SELECT *, {NORM} AS norm, TRY_CAST(regexp_extract(text, '([0-9]+)[^0-9]*$', 1) AS INT) AS num, oy < page_h * 0.12 AS top FROM noted WHERE oy < page_h * 0.12 OR oy > page_h * 0.88),
    al AS (SELECT *, count(*) FILTER (top) OVER (PARTITION BY doc_id, page) = 1 AS alone FROM e),
    tw AS (SELECT l.doc_id, l.line_no, bool_and(coalesce(m.num - l.num = m.page - l.page, FALSE)) AS counter, bool_or(abs(m.page - l.page) <= 8 AND trim(m.text, ' ') = trim(l.text, ' ')) AS again FROM e l JOIN e m ON l.doc_id = m.doc_id AND l.page <> m.page AND l.norm = m.norm AND abs(l.oy - m.oy) < 8
        AND NOT EXISTS (SELECT 1 FROM dups d WHERE d.doc_id = l.doc_id AND d.page_a = least(l.page, m.page) AND d.page_b = greatest(l.page, m.page)) GROUP BY ALL)
    SELECT al.doc_id, al.page, al.line_no FROM al LEFT JOIN tw ON al.doc_id = tw.doc_id AND al.line_no = tw.line_no WHERE regexp_full_match(norm, '[#\\s\\-–—/|.·()]*') OR regexp_full_match(trim(text, ' '), '(?i)[ivxlcdm]+') OR (counter IS NOT NULL AND NOT (top AND alone AND size >= 9.5 * 1.1 AND NOT counter AND NOT again)) OR (top AND size < 9.5 * 0.8)""")
def page_furniture(spark, sf_dir):
    rows = _noted(spark, sf_dir)
    return pages.furniture(rows, rows.select("doc_id").distinct().withColumn("body", F.lit(9.5)))


_PLACED = "placed AS (SELECT doc_id, page, line_no AS para, text, (n % 25) / 25.0::DOUBLE AS cx, (line_no % 6 * 10 + n % 2) / 60.0::DOUBLE AS cy FROM noted), p AS (SELECT *, CASE WHEN regexp_full_match(regexp_replace(text, '\\s+', '', 'g'), '[0-9]{1,4}') THEN '0' ELSE regexp_replace(text, '\\s+', '', 'g') END AS key FROM placed)"


@query(f"""WITH {GEO}, {_NOTED}, {_PLACED} SELECT doc_id, page, para FROM p WHERE length(key) BETWEEN 1 AND 40 AND EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.key = p.key AND q.page <> p.page AND abs(q.cy - p.cy) < 0.03 AND (abs(q.cx - p.cx) < 0.03 OR abs(p.cx - 1 + q.cx) < 0.03))""")
def repeated_at_place(spark, sf_dir):
    n = F.col("n")
    return lines.repeated_at_place(_noted(spark, sf_dir).select("doc_id", "page", F.col("line_no").alias("para"), "text", (n % 25 / 25.0).alias("cx"), ((F.col("line_no") % 6 * 10 + n % 2) / 60.0).alias("cy")))


_GOOD = r"conf >= 60 AND regexp_matches(text, '\p{L}.*\p{L}|\p{N}.*\p{N}') AND NOT regexp_matches(text, '[{}|<>\\]')"


@query(f"WITH {GEO} SELECT doc_id, line_no FROM (SELECT *, 40 + n % 60 AS conf FROM geo) WHERE {_GOOD}")
def good_lines(spark, sf_dir):
    return _geo(spark, sf_dir).filter(pages.good_line(F.col("text"), 40 + F.col("n") % 60)).select("doc_id", "line_no")


@query(f"""WITH {GEO}, l AS (SELECT *, 60 + n % 40 AS conf, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS core FROM geo), w AS (SELECT doc_id, line_no, n, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM geo),
    s AS (SELECT doc_id, line_no, max(pos * 40 + length(t) * 5) - min(pos * 40) AS w, greatest(1, max(10 + n % 3)) AS h, sum(length(t) * 5) AS ink FROM w WHERE trim(t) <> '' AND 45 + length(t) * 7 % 50 >= 50 GROUP BY ALL)
    SELECT doc_id, line_no FROM l JOIN s USING (doc_id, line_no) WHERE {_GOOD} AND conf >= 70 AND NOT (length(core) >= 4 AND replace(core, core[1], '') = '') AND NOT (length(core) <= 4 AND w / h < 0.45) AND ink / greatest(1, w) >= CASE WHEN length(core) <= 4 THEN 0.34 ELSE 0.22 END""")
def good_scan_lines(spark, sf_dir):
    rows = _geo(spark, sf_dir).withColumn("confidence", 60 + F.col("n") % 40)
    t = F.length("t")
    words = rows.select("doc_id", "line_no", "n", F.posexplode(F.split("text", " ")).alias("pos", "t")).select("doc_id", "line_no", F.col("t").alias("text"), (45 + t * 7 % 50).alias("confidence"), (F.col("pos") * 40).alias("x0"), (F.col("pos") * 40 + t * 5).alias("x1"), F.lit(0).alias("y0"), (10 + F.col("n") % 3).alias("y1"))
    return pages.good_scan_lines(rows, words)


@query(f"""WITH {GEO}, a AS (SELECT * FROM figs WHERE label IN ('header', 'footer') AND score >= 0.45 AND (y1 <= page_h * 0.2 OR y0 >= page_h * 0.8))
    SELECT DISTINCT f.doc_id, f.page, f.box_id FROM figs f JOIN a ON f.doc_id = a.doc_id AND f.page = a.page WHERE greatest(0, least(f.x1, a.x1) - greatest(f.x0, a.x0)) * greatest(0, least(f.y1, a.y1) - greatest(f.y0, a.y0)) >= 0.6 * (f.x1 - f.x0) * (f.y1 - f.y0)""")
def figures_in_furniture(spark, sf_dir):
    figs = _figs(spark, sf_dir)
    return pages.mostly_in(figs, pages.furniture_boxes(figs))


@query(f"""WITH {GEO}, p AS (SELECT DISTINCT doc_id, page FROM figs), ys AS (SELECT unnest(range(0, 80)) * 4 + 2 AS y), xs AS (SELECT unnest(range(0, 120)) * 4 + 2 AS x),
    b AS (SELECT doc_id, page, y, x0, x1 FROM figs JOIN ys ON y BETWEEN y0 AND y1), h AS (SELECT DISTINCT doc_id, page, y, x FROM b JOIN xs ON x BETWEEN x0 AND x1), c AS (SELECT doc_id, page, count(*) AS hit FROM h GROUP BY ALL) SELECT doc_id, page, coalesce(hit, 0) AS hit, 9600 AS total FROM p LEFT JOIN c USING (doc_id, page)""")
def raster_cover(spark, sf_dir):
    return pages.raster_cover(_figs(spark, sf_dir))


@query(f"WITH {GEO} SELECT doc_id, page, box_id FROM figs WHERE label IN ('image', 'chart') AND score >= 0.45 AND x1 - x0 >= 28 AND y1 - y0 >= 24 AND (x1 - x0) * (y1 - y0) BETWEEN page_w * page_h * 0.006 AND page_w * page_h * 0.72")
def image_areas(spark, sf_dir):
    return pages.image_areas(_figs(spark, sf_dir)).select("doc_id", "page", "box_id")


@query(f"""WITH {GEO}, i AS (SELECT doc_id, page, line_no AS box_id, oy - 16 AS y0, oy - 6 + n % 3 AS y1, page_h FROM geo), t AS (SELECT * FROM i WHERE y1 - y0 <= page_h * 0.1 AND (y1 <= page_h * 0.12 OR y0 >= page_h * 0.88))
    SELECT t.doc_id, t.page, t.box_id FROM t JOIN i ON t.doc_id = i.doc_id AND t.page <> i.page AND abs(t.y0 - i.y0) <= 3 AND abs(least(i.y1, i.page_h) - t.y1) <= 3 GROUP BY ALL HAVING count(DISTINCT i.page) >= 2""")
def running_bands(spark, sf_dir):
    rows = _geo(spark, sf_dir)
    return pages.running_bands(rows.select("doc_id", "page", F.col("line_no").alias("box_id"), (F.col("oy") - 16).alias("y0"), (F.col("oy") - 6 + F.col("n") % 3).alias("y1"), "page_h"))


# lines and boxes


@query(f"""WITH {GEO}, g AS (SELECT doc_id, page, x0, x1, oy - size AS y0, oy AS y1 FROM geo),
    j AS (SELECT f.doc_id, f.page, f.box_id, (f.x1 - f.x0) * (f.y1 - f.y0) AS area, (g.x0 + g.x1) / 2 > f.x0 AND (g.x0 + g.x1) / 2 < f.x1 AND (g.y0 + g.y1) / 2 > f.y0 AND (g.y0 + g.y1) / 2 < f.y1 AS c, (g.x1 - g.x0) * (g.y1 - g.y0) AS ink, g.x1 > f.x0 AND g.x0 < f.x1 AND g.y1 > f.y0 AND g.y0 < f.y1 AS m, g.x0 >= f.x0 - 1 AND g.x1 <= f.x1 + 1 AND g.y0 >= f.y0 - 1 AND g.y1 <= f.y1 + 1 AS w FROM figs f LEFT JOIN g ON f.doc_id = g.doc_id AND f.page = g.page),
    a AS (SELECT doc_id, page, box_id, coalesce(sum(ink) FILTER (c), 0) / area AS cover, count(*) FILTER (m AND w) AS inside, count(*) FILTER (m AND NOT w) AS straddle FROM j GROUP BY doc_id, page, box_id, area)
    SELECT doc_id, page, box_id, round(cover, 3) AS cover, inside, straddle, CASE WHEN cover >= 0.28 OR (inside >= 20 AND straddle <= inside * 0.05) THEN 'panel' ELSE 'figure' END AS kind FROM a""")
def region_cover(spark, sf_dir):
    glyphs = _geo(spark, sf_dir).select("doc_id", "page", "x0", "x1", (F.col("oy") - F.col("size")).alias("y0"), F.col("oy").alias("y1"))
    return pages.region_cover(_figs(spark, sf_dir), glyphs)


@query(f"""WITH {GEO}, m AS (SELECT doc_id, page, line_no AS box_id, x0 - 2 + n % 3 * 20 AS a, x1 - n % 4 * 30 AS b, oy - size AS y0, oy + 1 AS y1 FROM geo), l AS (SELECT *, oy - size * 0.35 AS y, (x0 + x1) / 2 AS x FROM geo),
    j AS (SELECT l.doc_id, l.page, l.line_no, l.x0, l.x1, x, m.box_id, a, b, b > l.x0 AND a < l.x1 AS band FROM l JOIN m ON l.doc_id = m.doc_id AND l.page = m.page AND y > m.y0 - 1 AND y < m.y1 + 1),
    k AS (SELECT *, max(CASE WHEN band THEN least(x1, b) END) OVER (PARTITION BY doc_id, page, line_no ORDER BY a, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j)
    SELECT doc_id, page, line_no, bool_or(band) AS touched, bool_or(x > a - 1 AND x < b + 1) AND sum(CASE WHEN band THEN greatest(0, least(x1, b) - greatest(greatest(x0, a), coalesce(before, greatest(x0, a)))) ELSE 0 END) >= (x1 - x0) * 0.9 AS highlighted FROM k GROUP BY doc_id, page, line_no, x0, x1""")
def highlighted_lines(spark, sf_dir):
    n, rows = F.col("n"), _geo(spark, sf_dir)
    marks = rows.select("doc_id", "page", F.col("line_no").alias("box_id"), (F.col("x0") - 2 + n % 3 * 20).alias("x0"), (F.col("x1") - n % 4 * 30).alias("x1"), (F.col("oy") - F.col("size")).alias("y0"), (F.col("oy") + 1).alias("y1"))
    return pages.highlighted(rows, marks)


@query(f"""WITH {GEO}, j AS (SELECT g.doc_id, g.page, g.line_no, f.box_id, g.x0 >= f.x0 AND g.x0 <= f.x1 + g.size * 2 AND g.x1 > f.x1 AS l, g.x1 <= f.x1 AND g.x1 >= f.x0 - g.size * 2 AND g.x0 < f.x0 AS r FROM geo g JOIN figs f ON g.doc_id = f.doc_id AND g.page = f.page AND g.oy - g.size * 0.35 BETWEEN f.y0 - g.size AND f.y1 + g.size)
    SELECT doc_id, page, line_no, max(box_id) FILTER (l) AS wrap_left, max(box_id) FILTER (r) AS wrap_right FROM j GROUP BY doc_id, page, line_no HAVING bool_or(l) OR bool_or(r)""")
def wrapped_lines(spark, sf_dir):
    return pages.wraps(_geo(spark, sf_dir), _figs(spark, sf_dir))


@query(f"""WITH {GEO}, w AS (SELECT doc_id, page, line_no AS word, (x0 + x1) / 4 AS cx, oy AS cy FROM geo), j AS (SELECT w.*, box_id, cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 AS i, (cx - (x0 + x1) / 2) ** 2 + (cy - (y0 + y1) / 2) ** 2 AS d FROM w JOIN figs f ON w.doc_id = f.doc_id AND w.page = f.page)
    SELECT doc_id, page, word, coalesce(min(box_id) FILTER (i), arg_min(box_id, (d, box_id))) AS cell FROM j GROUP BY doc_id, page, word""")
def words_to_cells(spark, sf_dir):
    words = _geo(spark, sf_dir).select("doc_id", "page", F.col("line_no").alias("word"), ((F.col("x0") + F.col("x1")) / 4).alias("cx"), F.col("oy").alias("cy"))
    return pages.words_to_cells(words, _figs(spark, sf_dir))


@query(f"""WITH {GEO}, a AS (SELECT * FROM figs WHERE n % 2 = 0), b AS (SELECT * FROM figs WHERE n % 2 = 1)
    SELECT doc_id, page, box_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.page = a.page AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.3 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)))""")
def tables_apart(spark, sf_dir):
    figs = _figs(spark, sf_dir)
    return pages.without_overlaps(figs.filter("n % 2 = 0"), figs.filter("n % 2 = 1")).select("doc_id", "page", "box_id")


@query(f"""WITH {GEO}, u AS (SELECT doc_id, page, oy AS y, 0 AS source, line_no AS item FROM geo UNION ALL SELECT doc_id, page, y0, 1, box_id FROM figs) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y, source, item) AS INT) AS place FROM u""")
def parts_in_order(spark, sf_dir):
    parts = _geo(spark, sf_dir).select("doc_id", "page", F.col("oy").alias("y"), F.col("line_no").alias("item"))
    return pages.in_page_order(parts, _figs(spark, sf_dir).select("doc_id", "page", F.col("y0").alias("y"), F.col("box_id").alias("item")))


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS doc_id, k AS style, CASE WHEN k > 1 THEN k - 1 ELSE 3 END AS up, CASE WHEN o_orderkey % 31 = 0 THEN TRUE WHEN o_orderkey % 37 = 0 THEN FALSE END AS bold, CASE WHEN o_orderkey % 23 = 0 THEN o_totalprice END AS size FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) o),
    c AS (SELECT doc_id, style, up, bold, size, 1 AS d FROM s UNION ALL SELECT c.doc_id, c.style, s.up, coalesce(c.bold, s.bold), coalesce(c.size, s.size), d + 1 FROM c JOIN s ON s.doc_id = c.doc_id AND s.style = c.up WHERE d < 20)
    SELECT doc_id, CAST(style AS INT) AS style, arg_max(bold, d) AS bold, arg_max(size, d) AS size FROM (SELECT doc_id, style, bold, size, d FROM c QUALIFY d = max(d) OVER (PARTITION BY doc_id, style)) GROUP BY ALL""")
def style_chains(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    order = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("style"), F.when(order % 31 == 0, True).when(order % 37 == 0, False).alias("bold"), F.when(order % 23 == 0, F.col("o_totalprice")).alias("size"))
    rows = rows.withColumn("based_on", F.when(F.col("style") > 1, F.col("style") - 1).otherwise(3))
    return pages.style_chains(rows)


# aggregates


@query(f"WITH {GEO}, g AS (SELECT doc_id, size, unnest(range(0, n)) AS i FROM geo) SELECT doc_id, median(size) AS body FROM g GROUP BY doc_id")
def body_sizes(spark, sf_dir):
    return pages.body_size(_geo(spark, sf_dir))


@query(f"""WITH {GEO}, s AS (SELECT doc_id, count(*) FILTER (line_no % 5 = n % 4) AS i, count(*) FILTER (line_no % 5 <> n % 4 AND n % 3 = 0) AS g FROM geo GROUP BY doc_id) SELECT doc_id, CASE WHEN i >= 2 AND i > g * 2 THEN 'indent' WHEN g >= 2 THEN 'gap' ELSE 'unknown' END AS style FROM s""")
def paragraph_styles(spark, sf_dir):
    reason = F.when(F.col("line_no") % 5 == F.col("n") % 4, "indent").when(F.col("n") % 3 == 0, "gap").otherwise("none")
    return pages.paragraph_style(_geo(spark, sf_dir).withColumn("reason", reason), "indent", "gap")


@query(f"""WITH {GEO}, b AS (SELECT doc_id, median(size) AS body FROM (SELECT doc_id, size, unnest(range(0, n)) AS i FROM geo) GROUP BY doc_id), c AS (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS k FROM geo)
    SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS lines, round(any_value(body), 2) AS body, CAST(sum(k) AS BIGINT) AS chars, count(*) FILTER (angle >= 0.3) AS rotated, count(*) FILTER (n % 9 = 0) AS flagged, CAST(sum(CASE WHEN weight >= 600 THEN k ELSE 0 END) AS BIGINT) AS bold_chars FROM c LEFT JOIN b USING (doc_id) GROUP BY doc_id""")
def document_stats(spark, sf_dir):
    rows = _geo(spark, sf_dir)
    return pages.document_stats(rows, rows.select("doc_id", (F.col("n") % 9 == 0).alias("flagged")))


_RUNS = "runs AS (SELECT doc_id, line_no // 4 AS para, line_no AS pos, n, [n % 3 * 60, n % 2 * 50, 0] AS colour, weight, n % 6 = 1 AS italic FROM geo WHERE n > 0)"


def _runs(spark, sf_dir) -> DataFrame:
    n = F.col("n")
    return _geo(spark, sf_dir).filter(n > 0).select("doc_id", F.floor(F.col("line_no") / 4).alias("para"), F.col("line_no").alias("pos"), "n", F.array(n % 3 * 60, n % 2 * 50, F.lit(0)).alias("colour"), "weight", (n % 6 == 1).alias("italic"))


@query(f"""WITH {GEO}, {_RUNS}, c AS (SELECT doc_id, colour, sum(n) AS k, min(pos) AS f FROM runs GROUP BY ALL), b AS (SELECT doc_id, arg_max(colour, (k, -f)) AS body FROM c GROUP BY doc_id), d AS (SELECT doc_id, para, colour, sum(n) AS k, min(pos) AS f FROM runs GROUP BY ALL), o AS (SELECT doc_id, para, arg_max(colour, (k, -f)) AS own FROM d GROUP BY ALL),
    s AS (SELECT doc_id, para, body, sum(n) AS al, sum(CASE WHEN abs(colour[1] - body[1]) + abs(colour[2] - body[2]) + abs(colour[3] - body[3]) > 90 OR weight >= 600 OR italic THEN n ELSE 0 END) AS odd FROM runs JOIN b USING (doc_id) GROUP BY ALL)
    SELECT doc_id, CAST(para AS BIGINT) AS para, abs(own[1] - body[1]) + abs(own[2] - body[2]) + abs(own[3] - body[3]) > 90 AS coloured, odd >= al * 0.3 AS styled FROM s JOIN o USING (doc_id, para)""")
def styled_paragraphs(spark, sf_dir):
    return pages.styled_paragraphs(_runs(spark, sf_dir))


@query("""WITH h AS (SELECT user_id AS doc_id, CAST(event_id * 37 % 256 AS INT) // (1 + user_id % 3) AS level, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL), w AS (SELECT *, sum(n) OVER o AS w0, sum(n * level) OVER o AS s0, sum(n) OVER (PARTITION BY doc_id) AS al, sum(n * level) OVER (PARTITION BY doc_id) AS su FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY level)),
    b AS (SELECT doc_id, level, CASE WHEN al > w0 THEN w0 * (al - w0) * (s0 / w0 - (su - s0) / (al - w0)) * (s0 / w0 - (su - s0) / (al - w0)) END AS v FROM w)
    SELECT doc_id, greatest(115, least(195, coalesce(arg_max(level, (v, -level)) FILTER (v IS NOT NULL), 170))) AS threshold FROM b GROUP BY doc_id""")
def otsu_thresholds(spark, sf_dir):
    level = F.floor(F.col("event_id") * 37 % 256 / (1 + F.col("user_id") % 3)).cast("int")
    return pages.otsu_thresholds(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), level.alias("level"), F.lit(1).alias("n")))


_SET = "l AS (SELECT doc_id, line_no // 3 AS para, page, line_no, CASE WHEN n % 4 = 0 THEN x0 + 40 ELSE 36 + n % 2 * 5 END AS x0, CASE WHEN n % 4 = 0 THEN 196 - n % 3 * 12 ELSE 236 - n % 5 // 4 * 30 END AS x1, oy, size, 36 AS L, 236 AS R FROM geo)"


@query(f"""WITH {GEO}, {_SET}, p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id, para) AS n, median(size) OVER (PARTITION BY doc_id, para) AS mid, oy - lag(oy) OVER w AS step FROM l WINDOW w AS (PARTITION BY doc_id, para ORDER BY line_no)),
    t AS (SELECT *, abs(x0 - L) < mid * 0.3 OR (i = 1 AND x0 > L) AS lo, abs(x1 - R) < mid * 0.3 AS ro, abs((x0 - L) - (R - x1)) < mid * 0.3 AND x0 - L > mid AS c, i < n OR n = 1 AS body FROM p),
    a AS (SELECT doc_id, para, n, mid, min_by(page, line_no) AS page, min(x0) AS x0, min(oy - size) AS y0, max(x1) AS x1, max(oy) AS y1, bool_and(c) AS c, avg(CAST(lo AS INT)) FILTER (body) AS lo, avg(CAST(ro AS INT)) FILTER (body) AS ro, min_by(x0 - L, line_no) AS indent, median(step) FILTER (step > 0) AS pitch FROM t GROUP BY ALL)
    SELECT doc_id, CAST(para AS BIGINT) AS para, page, CAST(x0 AS DOUBLE) AS x0, y0, CAST(x1 AS DOUBLE) AS x1, y1, CASE WHEN c THEN 'center' WHEN ro > 0.8 AND lo > 0.8 AND n > 1 THEN 'justify' WHEN ro > 0.8 AND lo < 0.5 THEN 'right' ELSE 'left' END AS align, CAST(round(indent, 2) AS DOUBLE) AS indent, round(mid, 2) AS size, round(pitch, 2) AS pitch, n - 1 AS breaks FROM a""")
def paragraph_layouts(spark, sf_dir):
    n = F.col("n")
    rows = _geo(spark, sf_dir).select("doc_id", F.floor(F.col("line_no") / 3).alias("para"), "page", "line_no", F.when(n % 4 == 0, F.col("x0") + 40).otherwise(36.0 + n % 2 * 5).alias("x0"), F.when(n % 4 == 0, 196.0 - n % 3 * 12).otherwise(236.0 - F.floor(n % 5 / 4) * 30).alias("x1"), "oy", "size", F.lit(36.0).alias("left"), F.lit(236.0).alias("right"))
    return pages.paragraph_layout(rows)


@query(f"WITH {GEO}, b AS (SELECT doc_id, page, oy + size * 0.3 AS low FROM geo UNION ALL SELECT doc_id, page, y1 FROM figs) SELECT doc_id, page, max(low) AS bottom FROM b GROUP BY ALL HAVING max(low) < 320 * 0.6")
def page_breaks(spark, sf_dir):
    return pages.page_breaks(_geo(spark, sf_dir), _figs(spark, sf_dir))


@query(f"WITH {GEO}, w AS (SELECT doc_id, page, CAST(n % 5 - 2 AS INT) AS deg, CAST(sum(n) AS BIGINT) AS n FROM geo GROUP BY ALL) SELECT doc_id, page, arg_max(deg, (n, -abs(deg), -deg)) AS deg FROM w GROUP BY ALL")
def upright_angles(spark, sf_dir):
    return pages.upright_angles(_geo(spark, sf_dir).withColumn("deg", F.col("n") % 5 - 2))


@query(f"WITH {GEO}, w AS (SELECT doc_id, page, CAST(n % 5 * 2 - 4 AS INT) AS deg, CAST(sum((40 + n % 60) * length(regexp_replace(text, '\\s', '', 'g'))) AS BIGINT) AS s FROM geo GROUP BY ALL) SELECT doc_id, page, arg_max(deg, (s, -abs(deg), -deg)) AS deg, max(s) AS score FROM w GROUP BY ALL")
def best_angles(spark, sf_dir):
    return pages.best_angles(_geo(spark, sf_dir).select("doc_id", "page", (F.col("n") % 5 * 2 - 4).alias("deg"), "text", (40 + F.col("n") % 60).alias("confidence")))


_GAPS = "gaps AS (SELECT doc_id, line_no, pos AS spot, CAST(length(w) % 7 * 2 + CASE WHEN length(w) > 8 THEN 14 ELSE 0 END AS DOUBLE) AS gap, length(w) % 3 > 0 AS sp FROM (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM geo))"


@query(f"""WITH {GEO}, {_GAPS}, o AS (SELECT g.doc_id, g.line_no, g.spot, g.gap, count(*) AS k, median(h.gap) AS mid FROM gaps g JOIN gaps h ON g.doc_id = h.doc_id AND g.line_no = h.line_no AND h.sp AND h.spot <> g.spot WHERE g.gap - 0.5 > 18 GROUP BY ALL)
    SELECT doc_id, line_no, CAST(spot AS INT) AS spot FROM o WHERE k >= 2 AND gap > mid * 2.5""")
def suspect_gaps(spark, sf_dir):
    w = F.length("w")
    rows = _geo(spark, sf_dir).select("doc_id", "line_no", F.posexplode(F.split("text", " ")).alias("at", "w"))
    return pages.suspect_gaps(rows.select("doc_id", "line_no", "at", (w % 7 * 2.0 + F.when(w > 8, 14.0).otherwise(0.0)).alias("gap"), (w % 3 > 0).alias("is_space"), F.lit(10.0).alias("size"), F.lit(0.5).alias("tracking"))).withColumnRenamed("at", "spot")


_CELLS = "cells AS (SELECT doc_id, page, line_no AS box_id, CAST(n % 4 AS INT) AS col, CAST(line_no % 3 AS INT) AS r, CASE WHEN n % 5 = 0 THEN 2 ELSE 1 END AS cs, CASE WHEN n % 9 = 0 THEN 2 ELSE 1 END AS rs, n % 4 * 100.0 + n % 13 AS x0, n % 4 * 100.0 + 60 + n % 7 AS x1, oy AS y0, oy + n % 30 AS y1 FROM geo)"


def _cells(spark, sf_dir) -> DataFrame:
    n = F.col("n")
    return _geo(spark, sf_dir).select("doc_id", "page", F.col("line_no").alias("box_id"), (n % 4).alias("col"), (F.col("line_no") % 3).alias("row"), F.when(n % 5 == 0, 2).otherwise(1).alias("colspan"), F.when(n % 9 == 0, 2).otherwise(1).alias("rowspan"), (n % 4 * 100.0 + n % 13).alias("x0"), (n % 4 * 100.0 + 60 + n % 7).alias("x1"), F.col("oy").alias("y0"), (F.col("oy") + n % 30).alias("y1"))


@query(f"""WITH {GEO}, {_CELLS}, c AS (SELECT doc_id, page, col, list_sort(list((x0 + x1) / 2)) AS v FROM cells WHERE cs = 1 GROUP BY ALL), e AS (SELECT DISTINCT doc_id, page, unnest(range(0, 5)) AS col FROM geo),
    p AS (SELECT doc_id, page, col, coalesce(v[len(v) // 2 + 1], 0 + (col + 0.5) * 480 / 5) AS centre FROM e LEFT JOIN c USING (doc_id, page, col))
    SELECT doc_id, page, CAST(col AS INT) AS col, CAST(centre AS DOUBLE) AS centre, CAST(coalesce((lag(centre) OVER w + centre) / 2, 0) AS DOUBLE) AS x0, CAST(coalesce((lead(centre) OVER w + centre) / 2, 480) AS DOUBLE) AS x1 FROM p WINDOW w AS (PARTITION BY doc_id, page ORDER BY col)""")
def column_edges(spark, sf_dir):
    tables = _geo(spark, sf_dir).select("doc_id", "page").distinct().withColumns({"x0": F.lit(0.0), "x1": F.lit(480.0), "n_cols": F.lit(5)})
    return pages.column_edges(_cells(spark, sf_dir), tables)


@query(f"WITH {GEO}, {_CELLS}, h AS (SELECT doc_id, page, r AS \"row\", list_sort(list(y1 - y0)) AS v FROM cells WHERE rs = 1 AND y1 > y0 GROUP BY ALL) SELECT doc_id, page, \"row\", CAST(greatest(14, v[len(v) // 2 + 1]) AS DOUBLE) AS height FROM h")
def row_heights(spark, sf_dir):
    return pages.row_heights(_cells(spark, sf_dir))


@query(f"""WITH {GEO}, {_CELLS}, k AS (SELECT c.*, CASE WHEN col <> 3 THEN y0 + n % 11 END AS g0, CASE WHEN col <> 3 THEN y0 + n % 11 + 3 END AS g1 FROM cells c JOIN (SELECT doc_id, line_no AS box_id, n FROM geo) USING (doc_id, box_id)), f AS (SELECT *, (y1 - y0) - (g1 - g0) AS free FROM k)
    SELECT doc_id, page, box_id, CAST(greatest(0, coalesce(free, 0)) AS DOUBLE) AS free, CASE WHEN free IS NULL OR free < 4 THEN 'middle' WHEN (g0 - y0) / free < 0.3 THEN 'top' WHEN (g0 - y0) / free > 0.7 THEN 'bottom' ELSE 'middle' END AS align FROM f""")
def cell_aligns(spark, sf_dir):
    ink = _geo(spark, sf_dir).filter("n % 4 <> 3").select("doc_id", "page", F.col("line_no").alias("box_id"), (F.col("oy") + F.col("n") % 11).alias("y0"), (F.col("oy") + F.col("n") % 11 + 3).alias("y1"))
    return pages.cell_aligns(_cells(spark, sf_dir), ink)


# windows


@query(f"""WITH {GEO}, r AS (SELECT doc_id, page, line_no, oy, size, 50.0 + n % 3 * 4 AS usual, lag(oy) OVER w AS op, lag(size) OVER w AS sp, lag(page) OVER w AS pp, lag(oy, 2) OVER w AS oq, lag(size, 2) OVER w AS sq, lag(page, 2) OVER w AS pq, lead(oy) OVER w AS o_n, lead(size) OVER w AS s_n, lead(page) OVER w AS p_n FROM geo WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    b AS (SELECT *, CASE WHEN abs(sp - size) < 0.5 AND abs(size - 9.5) > 9.5 * 0.12 THEN usual * size / 9.5 ELSE usual END AS base, least(CASE WHEN pq = pp AND abs(sq - sp) < 0.5 AND op > oq THEN op - oq END, CASE WHEN page = p_n AND abs(size - s_n) < 0.5 AND o_n > oy THEN o_n - oy END) AS beside FROM r WHERE op IS NOT NULL)
    SELECT doc_id, line_no, round(CAST(coalesce(greatest(base, beside), base) AS DOUBLE), 6) AS pitch FROM b""")
def local_pitches(spark, sf_dir):
    rows = _geo(spark, sf_dir).withColumn("pitch", 50.0 + F.col("n") % 3 * 4)
    return pages.local_pitch(rows, rows.select("doc_id").distinct().withColumn("body", F.lit(9.5))).withColumn("pitch", F.round("pitch", 6))


_SIGNS = "signs AS (SELECT doc_id, line_no, i - 1 AS ci, CASE WHEN substring(text, CAST(i AS BIGINT), 1) IN ('a', 'e', 'n') THEN '?' WHEN i > n - 2 THEN '7' ELSE substring(text, CAST(i AS BIGINT), 1) END AS c, CASE WHEN i % 40 = 0 THEN 'f' ELSE 'g' END AS font FROM geo, LATERAL (SELECT unnest(range(1, n + 1)) AS i) r)"


@query(f"""WITH {GEO}, {_SIGNS}, d AS (SELECT *, c = '?' AS dot, coalesce((c = '?') <> (lag(c) OVER w = '?') OR (c = '?' AND font <> lag(font) OVER w), TRUE) AS new FROM signs WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY ci)),
    r AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id, line_no ORDER BY ci) AS run, ci >= max(CASE WHEN NOT regexp_full_match(c, '[0-9]') THEN ci ELSE -1 END) OVER (PARTITION BY doc_id, line_no) AND ci < max(ci) OVER (PARTITION BY doc_id, line_no) AS tail FROM d),
    k AS (SELECT doc_id, line_no, run, count(*) AS n, bool_or(tail) AS tail FROM r WHERE dot GROUP BY ALL) SELECT doc_id, line_no, CAST(ci AS INT) AS ci FROM r SEMI JOIN (SELECT * FROM k WHERE n >= 3 OR (n = 2 AND tail)) g ON r.doc_id = g.doc_id AND r.line_no = g.line_no AND r.run = g.run WHERE dot""")
def dot_leaders(spark, sf_dir):
    rows = _geo(spark, sf_dir).filter("n > 0").select("doc_id", "line_no", "text")
    full = StructType(rows.schema.fields[:2] + StructType.fromDDL("glyphs array<struct<ci:int,c:string,x0:double,x1:double,size:double,font:string>>").fields)

    def signs(batches):
        import numpy as np
        import pyarrow as pa

        target = to_arrow_schema(full)
        glyphs = target.field("glyphs").type
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n = np.array([len(t) for t in texts], np.int64)
            start = np.cumsum(n) - n
            codes, k = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
            ci = np.arange(len(k)) - np.repeat(start, n)
            put = np.where(np.isin(codes, [ord(c) for c in "aen"])[k], len(codes), np.where(ci >= np.repeat(n, n) - 2, len(codes) + 1, k))
            parts = [pa.array(ci.astype(np.int32)), pa.array([*map(chr, codes.tolist()), "?", "7"]).take(pa.array(put)), pa.array(ci * 5.0), pa.array(ci * 5.0 + 4), pa.array(np.full(len(k), 10.0)), pa.array(["g", "f"]).take(pa.array(((ci + 1) % 40 == 0).astype(np.int8)))]
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(k)).astype(np.int32)), pa.StructArray.from_arrays(parts, fields=list(glyphs.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists.cast(glyphs)], schema=target)

    return pages.leader_runs(rows.mapInArrow(signs, full), "?")


@query(f"WITH {GEO}, d AS (SELECT DISTINCT doc_id, page, CAST(floor(n * 0.5 + 0.5) AS BIGINT) AS x FROM geo), l AS (SELECT *, lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS b FROM d) SELECT doc_id, page, x FROM l WHERE b IS NULL OR x - b > 3")
def spaced_cuts(spark, sf_dir):
    return pages.spaced_cuts(_geo(spark, sf_dir).select("doc_id", "page", (F.col("n") * 0.5).alias("x")))


@query(f"""WITH {GEO}, b AS (SELECT doc_id, page, line_no, CAST(n % 9 * 20 AS DOUBLE) AS x0, CAST(n % 9 * 20 + n AS DOUBLE) AS x1, line_no % 6 * 15.0 + n % 5 AS y0, line_no % 6 * 15.0 + n % 5 + 6 + n % 4 AS y1 FROM geo),
    q AS (SELECT *, lag(x0) OVER w AS p0, lag(x1) OVER w AS p1, lag(y0) OVER w AS q0, lag(y1) OVER w AS q1 FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, line_no)), h AS (SELECT *, greatest(1, y1 - y0, coalesce(q1 - q0, 0)) AS h FROM q),
    f AS (SELECT *, p0 IS NULL OR y0 - q1 > h * 1.25 OR greatest(0, least(x1, p1) - greatest(x0, p0)) / greatest(1, least(x1 - x0, p1 - p0)) < 0.35 OR abs(x0 - p0) > h * 2.5 AS new FROM h) SELECT doc_id, page, line_no, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, line_no) - 1 AS BIGINT) AS par FROM f""")
def read_paragraphs(spark, sf_dir):
    n, row = F.col("n"), F.col("line_no") % 6 * 15.0
    rows = _geo(spark, sf_dir).select("doc_id", "page", "line_no", (n % 9 * 20.0).alias("x0"), (n % 9 * 20.0 + n).alias("x1"), (row + n % 5).alias("y0"), (row + n % 5 + 6 + n % 4).alias("y1"))
    return pages.read_paragraphs(rows).select("doc_id", "page", "line_no", "par")


@query(f"""WITH {GEO}, p AS (SELECT doc_id, page, line_no, line_no % 2 AS col, oy AS y0, oy + n % 40 AS y1, 8.0 + n % 5 AS lh, CASE WHEN n % 3 = 0 THEN 14.0 + n % 4 END AS pitch FROM geo), q AS (SELECT *, lag(y1) OVER w AS b, greatest(lh, lag(lh) OVER w) AS h, greatest(coalesce(pitch, 0), coalesce(lag(pitch) OVER w, 0)) AS t FROM p WINDOW w AS (PARTITION BY doc_id, page, col ORDER BY y0)),
    e AS (SELECT *, CASE WHEN t > 0 THEN t ELSE h * 1.6 END AS each FROM q) SELECT doc_id, line_no, CAST(coalesce(CASE WHEN (y0 - b - greatest(0, each - h)) / each >= 0.75 THEN least(floor((y0 - b - greatest(0, each - h)) / each + 0.5), 3) END, 0) AS INT) AS blanks FROM e""")
def region_blanks(spark, sf_dir):
    n = F.col("n")
    rows = _geo(spark, sf_dir).select("doc_id", "page", "line_no", (F.col("line_no") % 2).alias("col"), F.col("oy").alias("y0"), (F.col("oy") + n % 40).alias("y1"), (8.0 + n % 5).alias("lh"), F.when(n % 3 == 0, 14.0 + n % 4).alias("pitch"))
    return pages.gaps_between_regions(rows).select("doc_id", "line_no", "blanks")


# scalar rules


@query("""WITH m AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 20) || '.' WHEN 1 THEN chr(CAST(97 + o_custkey % 26 AS INT)) || ')' WHEN 2 THEN '•' ELSE chr(CAST(9312 + o_custkey % 20 AS INT)) END AS a, CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 20 + o_orderkey % 3) || '.' WHEN 1 THEN chr(CAST(97 + (o_custkey + o_orderkey % 3) % 26 AS INT)) || ')' WHEN 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN '•' ELSE '◦' END ELSE chr(CAST(9312 + (o_custkey + o_orderkey % 3) % 20 AS INT)) END AS b, o_orderkey % 3 = 1 AS up,
    CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN o_custkey % 26 < 25 WHEN 2 THEN FALSE ELSE o_custkey % 20 < 19 END AS room FROM orders) SELECT o_orderkey, a, b, CASE WHEN o_orderkey % 4 = 2 THEN a = b ELSE up AND room END AS follows FROM m""")
def next_marks(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    letters, rings = F.array(*(F.lit(chr(97 + i)) for i in range(26))), F.array(*(F.lit(chr(9312 + i)) for i in range(20)))
    mark = lambda by: F.when(k % 4 == 0, F.concat(c % 20 + by, F.lit("."))).when(k % 4 == 1, F.concat(F.get(letters, ((c + by) % 26).cast("int")), F.lit(")"))).when(k % 4 == 3, F.get(rings, ((c + by) % 20).cast("int")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(mark(F.lit(0)), F.lit("•")).alias("a"), F.coalesce(mark(k % 3), F.when(k % 3 == 0, "•").otherwise("◦")).alias("b"))
    return rows.withColumn("follows", S.same_list_next("a", "b"))


@query("SELECT o_orderkey, '<' || o_orderstatus || '> & \"' || chr(CAST(200 + o_custkey % 700 AS INT)) || '''' || '&copy; &' || o_orderpriority || '😀' AS text FROM orders")
def decoded_entities(spark, sf_dir):
    coded = F.concat(F.lit("&lt;"), "o_orderstatus", F.lit("&GT; &amp; &quot;&#x"), F.hex(200 + F.col("o_custkey") % 700), F.lit(";&#39;&copy; &"), "o_orderpriority", F.lit("&#128512;"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.decoded_entities(coded).alias("text"))


_FONT = "CASE p_partkey % 6 WHEN 0 THEN 'ABCDEF+' ELSE '' END || replace(p_name, ' ', '') || CASE p_partkey % 5 WHEN 0 THEN '-Bold' WHEN 1 THEN 'EB' WHEN 2 THEN '_sb' WHEN 3 THEN '-Light' ELSE 'Batang' END"


@query(f"""WITH f AS (SELECT p_partkey, {_FONT} AS f FROM part), b AS (SELECT p_partkey, f, regexp_replace(f, '^[A-Z]{{6}}\\+', '') AS n FROM f), c AS (SELECT *, regexp_replace(n, '[-,](Bold|Regular|Medium|Light|SemiBold|ExtraBold|Italic|[a-z]{{1,2}}[A-Z][a-z]+).*$', '') AS base FROM b)
    SELECT p_partkey, regexp_matches(n, '(?i)bold|black|heavy|semibold|extrabold|굵') OR regexp_matches(n, '[a-z](B|EB|XB|SB|Bd|Bk)$') OR regexp_matches(n, '(?i)[-_ ](B|EB|XB|SB)$') AS bold, '"' || base || '","' || regexp_replace(base, '([a-z])([A-Z])', '\\1 \\2', 'g') || '",' || CASE WHEN regexp_matches(f, '(?i)myeong|batang|serif|book|명조|바탕|gowun|times|mincho') THEN '"Noto Serif KR","Noto Serif CJK KR","Nanum Myeongjo","Batang",serif' ELSE '"Noto Sans KR","Noto Sans CJK KR","Nanum Gothic","Malgun Gothic",sans-serif' END AS css FROM c""")
def font_names(spark, sf_dir):
    k = F.col("p_partkey")
    tail = F.when(k % 5 == 0, "-Bold").when(k % 5 == 1, "EB").when(k % 5 == 2, "_sb").when(k % 5 == 3, "-Light").otherwise("Batang")
    name = F.concat(F.when(k % 6 == 0, "ABCDEF+").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("")), tail)
    return table(spark, sf_dir, "part").select("p_partkey", S.is_bold_font(name).alias("bold"), S.font_css(name).alias("css"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS user, event_type AS usual, 'Say ' || event_type || ' to ' || user_id AS prompt FROM events""")
def answers(spark, sf_dir):
    body = F.to_json(F.struct(F.struct(F.struct("user_id").alias("b")).alias("a"), F.struct(F.col("event_type").alias("text")).alias("data")))
    return table(spark, sf_dir, "events").withColumn("body", body).select("event_id", S.result_at("body", "a..b.user_id").alias("user"), S.result_at("body").alias("usual"), S.filled(F.lit("Say {{text}} to {{who}}"), text=F.col("event_type"), who=F.col("user_id")).alias("prompt"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 3 < 2 THEN p_size ELSE 595 END AS DOUBLE) AS width, CAST(CASE p_size % 3 WHEN 0 THEN p_size * 2 WHEN 1 THEN 7 ELSE 842 END AS DOUBLE) AS height FROM part")
def svg_sizes(spark, sf_dir):
    n = F.col("p_size")
    box = F.concat(F.lit("<x/><svg class='a' width=\"3\" viewBox=\"0 0 "), n, F.lit(" "), n * 2, F.lit('">'))
    svg = F.when(n % 3 == 0, box).when(n % 3 == 1, F.concat(F.lit("<SVG height='7' width='"), n, F.lit("'>"))).otherwise("<svg><g width='9'>")
    return table(spark, sf_dir, "part").withColumn("s", S.svg_size(svg)).select("p_partkey", "s.width", "s.height")


@query(f"""WITH {LINES}, a AS (SELECT doc_id, line_no, text, least(line_no * 7 % 90, length(text)) AS k FROM lines), p AS (SELECT *, length(regexp_extract(left(text, k), '[\\p{{L}}\\p{{N}}_]*$')) AS l, length(regexp_extract(substring(text, k + 1), '^[\\p{{L}}\\p{{N}}_]*')) AS r FROM a) SELECT doc_id, line_no, CAST(k - l AS INT) AS start, CAST(l + r AS INT) AS length FROM p WHERE l + r > 0""")
def words_at(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("w", S.word_at("text", F.col("line_no") * 7 % 90)).filter("w is not null")
    return rows.select("doc_id", "line_no", "w.start", "w.length")
