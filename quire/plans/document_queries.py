"""Queries of the operators on glyph rows and whole documents, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import documents, flow, pages, segments
from quire.plans.page_queries import GEO, _figs, _geo
from quire.plans.queries import LINES, _PAIRS, _SEAMS, _lines, query, table
from quire.sources import archives

#: The words of lines as pieces with places: six points a character, 3 more in each third word, larger ones now and then.
PIECES = f"""{GEO}, pieces AS (SELECT doc_id, page, line_no, oy, CAST(ci AS INT) AS ci, w, ci * 40.0 + length(w) % 3 * 4 AS x0, ci * 40.0 + length(w) % 3 * 4 + length(w) * 6 AS x1, CASE WHEN length(w) % 5 = 4 THEN 21.0 ELSE 10.0 END AS size, CASE WHEN length(w) % 4 = 0 THEN 'ABCDEF+Sans-Bold' ELSE 'serif,x' END AS font
    FROM (SELECT doc_id, page, line_no, oy, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS ci FROM geo) q)"""


def _pieces(spark, sf_dir, dealt: bool = False) -> DataFrame:
    """dealt: a document's lines are in one part before they become pieces, so windows over pieces need no shuffle."""
    n = F.length("w")
    rows = (_geo(spark, sf_dir).repartition("doc_id") if dealt else _geo(spark, sf_dir)).select("doc_id", "page", "line_no", "oy", F.posexplode(F.split("text", " ")).alias("ci", "w"))
    x0 = F.col("ci") * 40.0 + n % 3 * 4
    return rows.select("*", x0.alias("x0"), (x0 + n * 6).alias("x1"), F.when(n % 5 == 4, 21.0).otherwise(10.0).alias("size"), F.when(n % 4 == 0, "ABCDEF+Sans-Bold").otherwise("serif,x").alias("font"))


# glyph rows


@query(f"""WITH {PIECES}, cuts AS (SELECT DISTINCT doc_id, page, 100.0 + n % 5 * 37 AS cut FROM geo), g AS (SELECT *, lead(x0) OVER (PARTITION BY doc_id, line_no ORDER BY ci) AS nx FROM pieces)
    SELECT DISTINCT g.doc_id, g.page, line_no, CAST(cut AS DOUBLE) AS cut FROM g JOIN cuts c ON g.doc_id = c.doc_id AND g.page = c.page WHERE (x0 <= cut AND x1 >= cut) OR (x1 <= cut AND nx >= cut AND nx - x1 < size * 0.5)""")
def row_covers(spark, sf_dir):
    cuts = _geo(spark, sf_dir).select("doc_id", "page", (100.0 + F.col("n") % 5 * 37).alias("cut")).distinct()
    return segments.row_covers(_pieces(spark, sf_dir), cuts)


@query(f"""WITH {PIECES}, t AS (SELECT doc_id, page, line_no AS table_id, 60.0 + n % 7 * 20 AS edge, oy AS t0, oy + 120 AS t1 FROM geo),
    j AS (SELECT p.*, table_id, edge, x1 <= edge + 1 AS l FROM pieces p JOIN t ON p.doc_id = t.doc_id AND p.page = t.page AND oy >= t0 - 80 AND oy <= t1),
    a AS (SELECT doc_id, page, line_no, table_id, count(*) FILTER (l) AS n_left, count(*) FILTER (NOT l) AS n_right, arg_max(x1, ci) FILTER (l) AS lx, arg_min(x0, ci) FILTER (NOT l) AS rx, arg_min(size, ci) FILTER (l) AS s FROM j GROUP BY ALL)
    SELECT doc_id, page, line_no, table_id, n_left, n_right FROM a WHERE n_left > 0 AND n_right > 0 AND rx - lx >= s""")
def split_at_edges(spark, sf_dir):
    rows, n = _geo(spark, sf_dir), F.col("n")
    tables = rows.select("doc_id", "page", F.col("line_no").alias("table_id"), (60.0 + n % 7 * 20).alias("x0"), F.col("oy").alias("y0"), (F.col("oy") + 120).alias("y1"))
    return segments.split_at_edges(rows, _pieces(spark, sf_dir).select("doc_id", "page", "line_no", "ci", "x0", "x1", "size"), tables)


@query(f"""WITH {PIECES}, f AS (SELECT *, lower(regexp_extract(regexp_replace(font, '^[A-Z]{{6}}\\+', ''), '^([^,-]*)', 1)) AS f FROM pieces), r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id, line_no) AS n, lead(x0) OVER w AS xn, lag(x1) OVER w AS xp, lead(f) OVER w AS fn, lag(f) OVER w AS fp FROM f WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY ci)),
    b AS (SELECT doc_id, line_no, list_sort(list(size)) AS s FROM pieces GROUP BY ALL)
    SELECT doc_id, page, line_no, ci FROM r JOIN b USING (doc_id, line_no) WHERE n >= 4 AND size >= s[len(s) // 2 + 1] * 2 AND ((i = 1 AND xn - x1 > s[len(s) // 2 + 1] * 1.5 AND f <> fn) OR (i = n AND x0 - xp > s[len(s) // 2 + 1] * 1.5 AND f <> fp))""")
def ornaments(spark, sf_dir):
    return segments.ornaments(_pieces(spark, sf_dir))


_SEGS = f"{GEO}, segs AS (SELECT doc_id, page, line_no, CAST(line_no % 2 AS INT) AS col, CASE WHEN n % 4 = 0 THEN 180.0 ELSE line_no % 2 * 240.0 END AS x0, CASE WHEN n % 4 = 0 THEN 300.0 ELSE line_no % 2 * 240.0 + 200 END AS x1, oy, size + CASE WHEN n % 8 = 0 THEN 6 ELSE 0 END AS size FROM geo)"


@query(f"""WITH {_SEGS}, c AS (SELECT doc_id, page, col, min(x0) AS edge, min(oy) AS top FROM segs GROUP BY ALL), m AS (SELECT s.*, edge, s.size > 9.5 * 1.3 AND NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = s.doc_id AND o.page = s.page AND o.col <> s.col AND o.top <= s.oy) AS above FROM segs s JOIN c USING (doc_id, page, col))
    SELECT doc_id, page, line_no FROM m WHERE abs((x0 + x1) / 2 - 240) <= greatest(size * 1.5, 480 * 0.03) AND (x0 - edge > size OR above) AND NOT EXISTS (SELECT 1 FROM segs o WHERE o.doc_id = m.doc_id AND o.page = m.page AND o.col <> m.col AND abs(o.oy - m.oy) < greatest(9.5 * 1.25, o.size) * 1.5)""")
def spanning_titles(spark, sf_dir):
    n, col = F.col("n"), F.col("line_no") % 2
    rows = _geo(spark, sf_dir)
    segs = rows.select("doc_id", "page", "line_no", col.alias("col"), F.when(n % 4 == 0, 180.0).otherwise(col * 240.0).alias("x0"), F.when(n % 4 == 0, 300.0).otherwise(col * 240.0 + 200).alias("x1"), "oy", (F.col("size") + F.when(n % 8 == 0, 6).otherwise(0)).alias("size"))
    spans = rows.select("doc_id", "page").distinct().withColumns({"x0": F.lit(0.0), "x1": F.lit(480.0), "body": F.lit(9.5)})
    return segments.spanning_titles(segs, spans)


@query(f"""WITH {PIECES}, r AS (SELECT doc_id, page, ci, w AS c, size, round(CAST(x0 * cos(0.5::DOUBLE) - oy * sin(0.5::DOUBLE) AS DOUBLE), 6) AS u, CAST(floor(0.5 * 20 + 0.5) AS BIGINT) AS turn, CAST(floor((x0 * sin(0.5::DOUBLE) + oy * cos(0.5::DOUBLE)) / 5 + 0.5) AS BIGINT) AS track FROM pieces WHERE trim(w) <> ''),
    s AS (SELECT *, u - lag(u) OVER (PARTITION BY doc_id, page, turn, track ORDER BY u, ci) AS step FROM r), k AS (SELECT doc_id, page, turn, track, list_sort(list(step)) AS a FROM s WHERE step > 0 GROUP BY ALL),
    t AS (SELECT s.*, CASE WHEN step > a[CAST(floor((len(a) - 1) * 0.3 + 0.5) AS BIGINT) + 1] * 1.2 + size * 0.1 THEN ' ' ELSE '' END || c AS t FROM s LEFT JOIN k USING (doc_id, page, turn, track))
    SELECT doc_id, page, turn, track, string_agg(t, '' ORDER BY u, ci, t) AS text FROM t GROUP BY ALL""")
def turned_lines(spark, sf_dir):
    rows = _pieces(spark, sf_dir, dealt=True).select("doc_id", "page", "ci", F.col("w").alias("c"), F.col("x0").alias("ox"), F.col("oy").alias("oy"), F.lit(0.5).alias("angle"), "size")
    return segments.turned_lines(rows)


@query(f"""WITH {PIECES}, g AS (SELECT doc_id, page, line_no // 2 AS para, x0, x1, oy - 10 AS y0, oy AS y1 FROM pieces), j AS (SELECT g.doc_id, g.page, f.box_id, para, g.x1 > f.x0 AND g.x0 < f.x1 AND g.y1 > f.y0 AND g.y0 < f.y1 AS t, (g.x0 + g.x1) / 2 BETWEEN f.x0 AND f.x1 AND (g.y0 + g.y1) / 2 BETWEEN f.y0 AND f.y1 AS c FROM g JOIN figs f ON g.doc_id = f.doc_id AND g.page = f.page)
    SELECT doc_id, page, box_id, CAST(para AS BIGINT) AS para FROM j GROUP BY ALL HAVING bool_or(t) AND count(*) FILTER (c) * 2 <= count(*)""")
def kept_chars(spark, sf_dir):
    glyphs = _pieces(spark, sf_dir).select("doc_id", "page", F.floor(F.col("line_no") / 2).alias("para"), "x0", "x1", (F.col("oy") - 10).alias("y0"), F.col("oy").alias("y1"))
    return segments.kept_chars(glyphs, _figs(spark, sf_dir))


@query(f"""WITH {GEO}, k AS (SELECT doc_id, page, box_id, CASE n % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'inside-drawn' ELSE 'panel' END AS kind, x0, y0, x1 + n % 7 * 60 AS x1, y1 + n % 5 * 60 AS y1 FROM figs)
    SELECT doc_id, page, box_id FROM k WHERE kind = 'figure' OR (kind = 'panel' AND (x1 - x0) * (y1 - y0) < 480 * 320 * 0.3) OR (kind = 'inside-drawn' AND EXISTS (SELECT 1 FROM k c WHERE c.kind = 'figure' AND c.doc_id = k.doc_id AND c.page = k.page AND (c.x1 - c.x0) * (c.y1 - c.y0) >= 480 * 320 * 0.3 AND (k.x0 + k.x1) / 2 > c.x0 AND (k.x0 + k.x1) / 2 < c.x1 AND (k.y0 + k.y1) / 2 > c.y0 AND (k.y0 + k.y1) / 2 < c.y1))""")
def listed_figures(spark, sf_dir):
    n = F.col("n")
    kind = F.when(n % 3 == 0, "figure").when(n % 3 == 1, "inside-drawn").otherwise("panel")
    return segments.listed_figures(_figs(spark, sf_dir).withColumns({"kind": kind, "x1": F.col("x1") + n % 7 * 60, "y1": F.col("y1") + n % 5 * 60}), cover=0.3)


@query()
def joined_fragments(spark, sf_dir):
    rows = _geo(spark, sf_dir).select("doc_id", "page", "line_no", "text", (F.col("line_no") % 3 * 80.0).alias("x0"), (F.col("line_no") % 3 * 80.0 + 50 + F.col("n") % 20).alias("x1"), (F.floor(F.col("line_no") % 6 / 3) * 20.0).alias("y0"), (F.floor(F.col("line_no") % 6 / 3) * 20.0 + 12).alias("y1"))
    return segments.joined_fragments(rows)


# documents


_ITEMS = "items AS (SELECT doc_id, line_no, CASE WHEN line_no % 10 < 3 THEN 'Name ' || line_no || ': ' || text WHEN line_no % 10 < 6 THEN (line_no % 10 - 2) || '. ' || text WHEN line_no % 10 < 8 THEN '~ ' || text ELSE text END AS text FROM lines)"


@query(rf"""WITH {LINES}, {_ITEMS}, p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM items), f AS (SELECT *, split_part(text, ' ', 1) AS a, split_part(prev, ' ', 1) AS b FROM p WHERE prev IS NOT NULL),
    r AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(text, '^[^\s:：.!?。][^:：.!?。]{{0,18}}\s*[:：]\s+\S') AND NOT regexp_matches(text, '^[^:：]*[0-9]\s*[:：]\s*[0-9]') AND regexp_matches(prev, '^[^\s:：.!?。][^:：.!?。]{{0,18}}\s*[:：]\s+\S') AND NOT regexp_matches(prev, '^[^:：]*[0-9]\s*[:：]\s*[0-9]') THEN 'labels'
        WHEN regexp_full_match(a, '[^\p{{L}}\p{{N}}\s]') AND a = b AND contains(text, ' ') THEN 'same sign' WHEN contains(text, ' ') AND regexp_full_match(a, '[0-9]{{1,2}}[.)]') AND regexp_full_match(b, '[0-9]{{1,2}}[.)]') AND right(a, 1) = right(b, 1) AND CAST(regexp_replace(a, '[^0-9]', '', 'g') AS INT) = CAST(regexp_replace(b, '[^0-9]', '', 'g') AS INT) + 1 THEN 'next mark' END AS reason FROM f) SELECT * FROM r WHERE reason IS NOT NULL""")
def list_breaks(spark, sf_dir):
    n, t = F.col("line_no") % 10, F.col("text")
    text = F.when(n < 3, F.concat(F.lit("Name "), "line_no", F.lit(": "), t)).when(n < 6, F.concat(n - 2, F.lit(". "), t)).when(n < 8, F.concat(F.lit("~ "), t)).otherwise(t)
    return documents.list_breaks(_lines(spark, sf_dir).withColumn("text", text))


_PARTS = "parts AS (SELECT doc_id, line_no AS part_no, page, rtrim(text, '.') AS text, line_no % 6 = 5 AS is_panel, CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END AS heading FROM geo)"


@query(rf"""WITH {GEO}, {_PARTS}, m AS (SELECT *, lag(part_no) OVER w AS pn, lag(page) OVER w AS pp, lag(text) OVER w AS pt, lag(heading) OVER w AS ph, min(part_no) OVER (PARTITION BY doc_id, page) AS f FROM parts WHERE NOT is_panel WINDOW w AS (PARTITION BY doc_id ORDER BY part_no))
    SELECT doc_id, part_no FROM m WHERE page = pp + 1 AND f = part_no AND EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = m.doc_id AND q.is_panel AND q.part_no > pn AND q.part_no < m.part_no) AND NOT regexp_matches(trim(pt), '[.!?。？！…:："”』」)\]]$') AND NOT regexp_matches(text, '^\s*([□■◆◇○●•▶ㅇo\-–*※]|\(?[0-9]{{1,3}}[.)]|[①-⑳㉠-㉭ⓐ-ⓩ])') AND heading = 0 AND ph = 0""")
def continued_parts(spark, sf_dir):
    rows = _geo(spark, sf_dir)
    return documents.continued_parts(rows.select("doc_id", F.col("line_no").alias("part_no"), "page", F.expr("rtrim('.', text)").alias("text"), (F.col("line_no") % 6 == 5).alias("is_panel"), F.when(F.col("n") % 10 == 0, 1).otherwise(0).alias("heading")))


@query(f"""WITH {GEO}, l AS (SELECT doc_id, line_no // 7 AS para, line_no, page % 3 <> 1 AS ok, row_number() OVER (PARTITION BY doc_id, line_no // 7 ORDER BY line_no) AS i FROM geo), k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, para ORDER BY line_no) AS island FROM l WHERE ok),
    g AS (SELECT doc_id, para, island, min(line_no) AS first_line, count(*) AS n_lines FROM k GROUP BY ALL) SELECT doc_id, CAST(para AS BIGINT) AS para, first_line, n_lines, CAST(row_number() OVER (PARTITION BY doc_id, para ORDER BY island) - 1 AS INT) AS part FROM g""")
def chosen_parts(spark, sf_dir):
    rows = _geo(spark, sf_dir)
    return documents.chosen_parts(rows.select("doc_id", F.floor(F.col("line_no") / 7).alias("para"), "line_no", "page"), rows.filter("page % 3 <> 1"))


@query(f"""WITH {LINES}, {_PAIRS}, {_SEAMS}, c AS (SELECT l.doc_id, l.line_no, l.text, kind FROM lines l LEFT JOIN seams s ON l.doc_id = s.doc_id AND l.line_no = s.line_no WHERE l.line_no >= 1), a AS (SELECT *, lead(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM c)
    SELECT doc_id, string_agg(CASE WHEN after = 'hyphen-drop' THEN regexp_replace(text, '-$', '') WHEN after = 'space' THEN text || ' ' WHEN after = 'para' THEN text || chr(10) ELSE text END, '' ORDER BY line_no) AS text FROM a GROUP BY doc_id""")
def selected_text(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return documents.selected_text(rows.filter("line_no >= 1"), flow.seams(rows))


@query(f"""WITH {GEO}, i AS (SELECT doc_id, box_id, CASE WHEN n % 11 <> 0 THEN box_id + n % 4 END AS b FROM figs), u AS (SELECT doc_id, line_no AS anchor, 1 AS kind, line_no, CAST(NULL AS INT) AS box_id FROM geo UNION ALL SELECT doc_id, coalesce(b, 2147483647), 0, NULL, box_id FROM i)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY anchor, kind, box_id) AS INT) AS place, line_no, box_id FROM u""")
def flow_order(spark, sf_dir):
    inserts = _figs(spark, sf_dir).select("doc_id", "box_id", F.when(F.col("n") % 11 != 0, F.col("box_id") + F.col("n") % 4).alias("before_line"))
    return documents.flow_order(_lines(spark, sf_dir), inserts)


@query("""WITH f AS (SELECT l_partkey, l_quantity, min((l_orderkey, l_linenumber)) AS f FROM lineitem GROUP BY ALL), n AS (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY f, l_quantity) AS number FROM f) SELECT l_orderkey, l_linenumber, l_partkey, CAST(number AS INT) AS number FROM lineitem JOIN n USING (l_partkey, l_quantity)""")
def first_occurrences(spark, sf_dir):
    return documents.first_occurrences(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_quantity"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "number")


@query("""WITH m AS (SELECT l_orderkey AS doc_id, l_linenumber AS id, CASE WHEN l_tax > 0.04 THEN CAST(l_suppkey % 9 AS INT) - 3 END AS page, CASE WHEN l_quantity > 25 THEN '#a0B1c2' ELSE 'red' END AS color, CASE WHEN l_discount > 0.05 THEN repeat(l_returnflag, 6000) END AS text, [l_quantity - 20, l_discount * 3e6] AS p, [CASE WHEN l_quantity > 40 THEN 0 ELSE l_quantity - 10 END, 5.0] AS s FROM lineitem)
    SELECT doc_id, id, greatest(0, coalesce(page, 0)) AS page, CASE WHEN color = 'red' THEN '#ffe066' ELSE color END AS color, coalesce(text, '') AS text, greatest(0, p[1]) AS x, greatest(0, p[2]) AS y, greatest(0, s[1]) AS w FROM m WHERE s[1] > 0""")
def clean_highlights(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    rect = F.struct((q - 20).alias("x"), (d * 3e6).alias("y"), F.when(q > 40, 0.0).otherwise(q - 10).alias("w"), F.lit(5.0).alias("h"))
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"), F.when(F.col("l_tax") > 0.04, (F.col("l_suppkey") % 9).cast("int") - 3).alias("page"), F.when(q > 25, "#a0B1c2").otherwise("red").alias("color"), F.when(d > 0.05, F.repeat("l_returnflag", F.lit(6000))).alias("text"), F.array(rect).alias("rects"))
    return documents.clean_highlights(marks).select("doc_id", "id", "page", "color", "text", *(F.get("rects", 0)[c].alias(c) for c in ("x", "y", "w")))


@query("""WITH r AS (SELECT user_id AS doc_id, event_id % 7 AS id, CAST(event_id % 3 AS DOUBLE) AS y, 10.0::DOUBLE AS h, CAST(event_id * 37 % 400 AS DOUBLE) AS x, CAST(event_id * 13 % 50 AS DOUBLE) AS w FROM events), b AS (SELECT *, max(x + w) OVER (PARTITION BY doc_id, id, y ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    n AS (SELECT *, sum(CASE WHEN x <= before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, id, y ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM b) SELECT doc_id, id, y, h, min(x) AS x, max(x + w) - min(x) AS w FROM n GROUP BY doc_id, id, y, h, part""")
def merged_rects(spark, sf_dir):
    k = F.col("event_id")
    return documents.merged_rects(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (k % 7).alias("id"), (k % 3).cast("double").alias("y"), F.lit(10.0).alias("h"), (k * 37 % 400).cast("double").alias("x"), (k * 13 % 50).cast("double").alias("w")))


@query("""WITH t AS (SELECT conv_id AS doc_id, turn, role, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, turn ORDER BY k) - 1 AS run_no FROM t WHERE text <> '')
    SELECT doc_id, 0 AS tab, 'T' || doc_id AS tab_name, CAST(turn AS INT) AS block_no, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 0 END AS heading, CASE role WHEN 'system' THEN 'center' ELSE 'left' END AS align, CAST(run_no AS INT) AS run_no, text, role = 'user' AS b, FALSE AS i, role = 'user' AS u, FALSE AS s, CAST(CASE WHEN role = 'system' THEN 14 END AS DOUBLE) AS size, CASE role WHEN 'user' THEN 'FF8000' END AS color FROM r""")
def structured_runs(spark, sf_dir):
    user, system = F.col("role") == "user", F.col("role") == "system"
    color = F.when(user, F.struct(F.struct(F.struct(F.lit(1.0).alias("red"), F.lit(0.5).alias("green")).alias("rgbColor")).alias("color")))
    style = F.struct(user.alias("bold"), user.alias("underline"), color.alias("foregroundColor"), F.when(system, F.struct(F.lit(14.0).alias("magnitude"))).alias("fontSize"))
    # a line end inside a run is written as the sign for a break
    run = F.struct(F.concat(F.translate("text", "\n", "\x0b"), F.lit("\n")).alias("content"), style.alias("textStyle"))
    named = F.struct(F.when(system, "HEADING_1").when(user, "HEADING_2").alias("namedStyleType"), F.when(system, "CENTER").alias("alignment"))
    block = F.struct(F.struct(F.array(F.struct(run.alias("textRun"))).alias("elements"), named.alias("paragraphStyle")).alias("paragraph"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("c")))).alias("c"))
    tab = F.struct(F.struct(F.concat(F.lit("T"), "conv_id").alias("title")).alias("tabProperties"), F.struct(F.struct(F.transform("c", lambda x: x["c"]).alias("content")).alias("body")).alias("documentTab"))
    return documents.structured_runs(turns.select(F.col("conv_id").alias("doc_id"), F.to_json(F.struct(F.array(tab).alias("tabs"))).alias("json")))


@query(r"""WITH t AS (SELECT conv_id AS doc_id, turn AS block_no, CASE role WHEN 'system' THEN 1 ELSE 0 END AS heading, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k, role FROM conversations), e AS (SELECT *, regexp_replace(t, '([\\`*_\[\]#|])', '\\\1', 'g') AS p, CASE WHEN k % 4 = 3 THEN '~~' ELSE '' END || CASE WHEN k % 2 = 1 THEN '**' ELSE '' END || CASE WHEN role = 'user' THEN '*' ELSE '' END AS m FROM t),
    c AS (SELECT *, regexp_replace(p, '^\s+|\s+$', '', 'g') AS core FROM e), r AS (SELECT *, CASE WHEN core = '' THEN p ELSE regexp_extract(p, '^(\s*)', 1) || m || core || reverse(m) || regexp_extract(p, '(\s*)$', 1) END AS o FROM c)
    SELECT doc_id, block_no, CASE WHEN heading > 0 THEN '# ' ELSE '' END || string_agg(o, '' ORDER BY k) AS text FROM r GROUP BY doc_id, block_no, heading""")
def markdown_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), F.when(F.col("role") == "system", 1).otherwise(0).alias("heading"), F.posexplode(F.split("text", "\n")).alias("run_no", "text"), (F.col("role") == "user").alias("i"))
    k = F.col("run_no") + 1
    return documents.markdown_runs(rows.withColumns({"b": k % 2 == 1, "s": k % 4 == 3}))


@query("SELECT conv_id AS doc_id, turn || '.txt' AS name, text FROM conversations")
def zip_round_trip(spark, sf_dir):
    members = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat("turn", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("data"))
    return archives.members(documents.zipped(members)).select("doc_id", "name", F.decode("data", "UTF-8").alias("text"))


@query("SELECT page_id, '<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>' || replace(replace(replace(replace(coalesce(url, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</title></head><body>' || html || '</body></html>' AS html FROM pages")
def web_documents(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", documents.web_document(S.escaped(F.coalesce("url", F.lit(""))), F.col("html")).alias("html"))


# scans, side notes, tables, runs, imports


@query(f"""WITH {GEO}, p AS (SELECT doc_id, page, sum(n) % 60 AS c, count(*) % 3 AS areas, sum(n) % 7 AS hit FROM geo GROUP BY ALL), s AS (SELECT doc_id, count(*) FILTER (c <= 48 AND hit >= 6 * 0.5) >= count(*) * 0.5 AS scans FROM p GROUP BY doc_id)
    SELECT doc_id, page, areas > 0 AND (c = 0 OR (c <= 48 AND hit >= 6 * 0.5 AND scans)) AS is_scan FROM p JOIN s USING (doc_id)""")
def scan_pages(spark, sf_dir):
    rows = _geo(spark, sf_dir).groupBy("doc_id", "page").agg((F.sum("n") % 60).alias("n_chars"), (F.count("*") % 3).alias("n_areas"), (F.sum("n") % 7).alias("hit"), F.lit(6).alias("total"))
    return pages.scan_pages(rows, share=0.5)


@query(f"""WITH {LINES}, s AS (SELECT doc_id, CAST(line_no // 40 AS INT) AS page, line_no, 0 AS panel, CAST(line_no % 2 AS INT) AS col, CAST(line_no % 40 // 2 * 14 + length(text) % 4 AS DOUBLE) AS oy, 0.0 AS x0, CASE WHEN line_no % 2 = 1 THEN length(text) % 6 * 10.0 ELSE 200.0 END AS x1, 10.0 AS size FROM lines),
    c AS (SELECT *, median(size) OVER w AS u, count(*) OVER w AS n, max(x1 - x0) OVER w AS wide FROM s WINDOW w AS (PARTITION BY doc_id, page, col)), m AS (SELECT c.doc_id, c.page, c.line_no, c.col, c.n, min(o.line_no) AS host FROM c JOIN s o ON o.doc_id = c.doc_id AND o.page = c.page AND o.panel = c.panel AND o.col = c.col - 1 AND abs(o.oy - c.oy) < u * 0.35 WHERE wide <= u * 5 GROUP BY ALL),
    k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, col) AS k FROM m) SELECT doc_id, page, line_no, host FROM k WHERE k >= 3 AND k >= n * 0.6""")
def side_notes(spark, sf_dir):
    at, n = F.col("line_no"), F.length("text")
    rows = _lines(spark, sf_dir).select("doc_id", F.floor(at / 40).cast("int").alias("page"), "line_no", F.lit(0).alias("panel"), (at % 2).alias("col"), (F.floor(at % 40 / 2) * 14.0 + n % 4).alias("oy"), F.lit(0.0).alias("x0"), F.when(at % 2 == 1, n % 6 * 10.0).otherwise(200.0).alias("x1"), F.lit(10.0).alias("size"))
    return pages.side_notes(rows)


@query(f"""WITH {GEO}, c AS (SELECT doc_id, page, line_no // 2 AS r, line_no % 2 AS c, '<td' || CASE WHEN n % 5 = 0 THEN ' colspan="2"' ELSE '' END || CASE WHEN n % 7 = 0 THEN ' rowspan="3"' ELSE '' END || CASE n % 3 WHEN 0 THEN ' style="text-align:center"' WHEN 1 THEN ' style="text-align:right"' ELSE '' END || '>' || CASE WHEN text = '' THEN '<br>' ELSE replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END || '</td>' AS td FROM geo),
    t AS (SELECT doc_id, page, r, '<tr>' || string_agg(td, '' ORDER BY c) || '</tr>' AS tr FROM c GROUP BY ALL) SELECT doc_id, page, '<table>' || string_agg(tr, '' ORDER BY r) || '</table>' AS html FROM t GROUP BY doc_id, page""")
def table_html(spark, sf_dir):
    n = F.col("n")
    cells = _geo(spark, sf_dir).select("doc_id", "page", F.floor(F.col("line_no") / 2).alias("row"), (F.col("line_no") % 2).alias("col"), F.when(n % 5 == 0, 2).otherwise(1).alias("colspan"), F.when(n % 7 == 0, 3).otherwise(1).alias("rowspan"), F.when(n % 3 == 0, "center").when(n % 3 == 1, "right").otherwise("left").alias("align"), "text")
    return pages.table_html(cells)


@query("WITH r AS (SELECT conv_id AS doc_id, turn AS block_no, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS run_no FROM conversations), s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, block_no ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r) SELECT doc_id, block_no, CAST(run_no AS INT) AS run_no, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS stop FROM s")
def run_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), F.posexplode(F.split("text", " ")).alias("run_no", "text"))
    return documents.run_offsets(rows).select("doc_id", "block_no", "run_no", "start", "stop")


@query("""WITH f AS (SELECT doc_id, 'f' || doc_id || ['.txt', '.MD', '.csv', '.docx', '.doc', '', '.rtf'][doc_id % 7 + 1] AS name, [ 'text', 'markdown', 'csv', 'parts', 'old format', NULL, 'rtf'][doc_id % 7 + 1] AS kind, text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, name, kind, CASE doc_id % 7 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 'x' || chr(10) || doc_id ELSE text END AS text FROM f""")
def imported_files(spark, sf_dir):
    k = (F.col("doc_id") % 7).cast("int")
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    name = F.concat(F.lit("f"), "doc_id", F.get(F.array(*map(F.lit, (".txt", ".MD", ".csv", ".docx", ".doc", "", ".rtf"))), k))
    # every other text with a byte order mark, in one of two encodings
    coded = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    rich = F.encode(F.concat(F.lit(r"{\rtf1{\fonttbl{\f0 A;}}x\par "), "doc_id", F.lit("}")), "UTF-8")
    return documents.imported(rows.select("doc_id", name.alias("name"), F.when(k == 6, rich).otherwise(coded).alias("content")))


@query(rf"""WITH {LINES}, b AS (SELECT doc_id, CAST(line_no // 12 AS INT) AS page, line_no, text, CASE WHEN length(text) % 6 = 0 THEN 10.0 WHEN line_no % 2 = 0 THEN 10.0 ELSE 200.0 END AS x0, CASE WHEN length(text) % 6 = 0 THEN 360.0 WHEN line_no % 2 = 0 THEN 10 + length(text) % 31 * 5.0 ELSE 200 + length(text) % 31 * 5.0 END AS x1, line_no % 12 // 2 * 20.0 + length(text) % 3 AS y0 FROM lines),
    r AS (SELECT *, y0 + 12 AS y1, count(*) OVER w AS n, min(x0) OVER w AS low, max(x1) OVER w - min(x0) OVER w AS wide, median(CAST(x1 - x0 AS DOUBLE) / greatest(1, length(regexp_replace(text, '\s', '', 'g')))) OVER w AS chr FROM b WINDOW w AS (PARTITION BY doc_id, page)),
    nr AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS k FROM r WHERE n >= 4 AND x1 - x0 < wide * 0.62), pt AS (SELECT doc_id, page, low, chr, k, unnest(range(CAST(floor(x0 - low) AS BIGINT), CAST(ceil(x1 - low) AS BIGINT) + 1)) AS x FROM nr), cv AS (SELECT doc_id, page, low, chr, k, x FROM pt GROUP BY ALL HAVING count(*) >= greatest(1, floor(k * 0.08 + 0.5))),
    g AS (SELECT doc_id, page, low + p + 1 AS g0, low + x AS g1 FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS p FROM cv) q WHERE k >= 4 AND x - p - 1 >= chr * 1.5),
    c AS (SELECT r.*, EXISTS (SELECT 1 FROM g WHERE g.doc_id = r.doc_id AND g.page = r.page AND x0 < g0 AND x1 > g1) AS over_, (SELECT count(*) FROM g WHERE g.doc_id = r.doc_id AND g.page = r.page AND (x0 + x1) / 2 > g0) AS col FROM r),
    t AS (SELECT *, min(CASE WHEN NOT over_ THEN y0 END) OVER (PARTITION BY doc_id, page) AS top FROM c), o AS (SELECT *, CASE WHEN n < 4 THEN 0 WHEN NOT over_ THEN 1 WHEN top IS NULL OR y1 <= top + 1 THEN 0 ELSE 2 END AS part FROM t)
    SELECT doc_id, page, line_no, CASE WHEN NOT over_ THEN col END AS col, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY part, CASE WHEN part = 1 THEN col END, CASE WHEN n < 4 THEN 0 WHEN part = 1 THEN y1 ELSE y0 END, CASE WHEN part = 1 THEN x0 END, line_no) AS INT) AS place FROM o""")
def column_order(spark, sf_dir):
    at, n = F.col("line_no"), F.length("text")
    left = F.when(F.col("line_no") % 2 == 0, 10.0).otherwise(200.0)
    y0 = F.floor(at % 12 / 2) * 20.0 + n % 3
    rows = _lines(spark, sf_dir).select("doc_id", F.floor(at / 12).cast("int").alias("page"), "line_no", "text", F.when(n % 6 == 0, 10.0).otherwise(left).alias("x0"), F.when(n % 6 == 0, 360.0).otherwise(left + n % 31 * 5).alias("x1"), y0.alias("y0"), (y0 + 12).alias("y1"))
    return pages.column_order(rows)


@query()
def image_text_areas(spark, sf_dir):
    images = _figs(spark, sf_dir).withColumns({"px_w": F.col("n") * 2, "px_h": F.col("n")})
    chars = _geo(spark, sf_dir).groupBy("doc_id", "page", "page_w", "page_h").agg((F.sum("n") % 90).alias("n_chars"))
    return pages.image_text_areas(images.drop("page_w", "page_h"), chars)


# scalar rules


@query("""SELECT p_partkey, [a1, b1, c1, d1, e1, f1] AS m FROM (SELECT p_partkey, CAST(2 * c AS DOUBLE) AS a1, CAST(2 * s AS DOUBLE) AS b1, CAST(-s AS DOUBLE) AS c1, CAST(c AS DOUBLE) AS d1, CAST(p_size * c - 3 * s + 1 AS DOUBLE) AS e1, CAST(p_size * s + 3 * c + 2 AS DOUBLE) AS f1 FROM (SELECT p_partkey, p_size, p_partkey % 3 AS c, p_partkey % 5 AS s FROM part) q) r""")
def composed_matrices(spark, sf_dir):
    c, s = (F.col("p_partkey") % 3).cast("double"), (F.col("p_partkey") % 5).cast("double")
    first = F.array(*map(F.lit, (2.0, 0.0, 0.0, 1.0)), F.col("p_size").cast("double"), F.lit(3.0))
    return table(spark, sf_dir, "part").select("p_partkey", S.composed(first, F.array(c, s, -s, c, F.lit(1.0), F.lit(2.0))).alias("m"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN chr(CAST(33 + p_partkey % 90 AS INT)) WHEN p_size % 4 = 2 THEN '❧' WHEN p_size % 4 = 0 THEN coalesce(map {'l': '●', 'n': '■', 'o': '□', 'q': '❑', 'u': '◆', 'v': '❖', 'w': '⬥', '"': '✂', '#': '✁', '(': '☎', ')': '✆', '*': '✉', ',': '📪', '-': '📫', 'J': '☺', 'L': '☹', 'F': '☞'}[chr(CAST(33 + p_partkey % 90 AS INT))], '•')
    ELSE coalesce(map {'l': '●', 'n': '■', 'o': '❏', 'q': '❑', 'u': '◆', 'H': '★', 'I': '✩', 's': '▲', 't': '▼', '3': '✓', '4': '✔', '7': '✗', '8': '✘', '+': '☛'}[chr(CAST(33 + p_partkey % 90 AS INT))], '•') END AS sign FROM part""")
def symbol_signs(spark, sf_dir):
    kind = F.col("p_size") % 4
    font = F.when(kind == 0, "ABCDEF+Wingdings").when(kind == 1, "ZapfDingbats").when(kind == 2, "Fleuron-Ornaments").otherwise("Serif")
    letter = F.char((33 + F.col("p_partkey") % 90).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.symbol_sign(font, letter).alias("sign"))


@query(f"WITH {LINES} SELECT doc_id, '<!--StartFragment-->' || string_agg('<p>' || CASE WHEN text = '' THEN '<br>' ELSE replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END || '</p>', '' ORDER BY line_no) || '<!--EndFragment-->' AS html FROM lines GROUP BY doc_id")
def pasted_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", S.pasted_html("text").alias("html"))


@query("""WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS col, l_quantity AS w, l_orderkey % 3 = 0 AS fit FROM lineitem), t AS (SELECT *, sum(w) OVER (PARTITION BY doc_id) AS total FROM w) SELECT doc_id, col, w, round(CASE WHEN total > 0 AND (fit OR total > 120) THEN w * (120 / total) ELSE w END, 1) AS width FROM t""")
def fitted_widths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("w"), (F.col("l_orderkey") % 3 == 0).alias("fit"))
    return rows.withColumn("width", F.round(S.fitted_width(F.col("w"), F.col("fit"), "doc_id", body=120.0), 1)).select("doc_id", "col", "w", "width")


@query("""WITH u AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events GROUP BY user_id), c AS (SELECT user_id, list_transform(k, lambda x: CASE x WHEN 'click' THEN 'eng' WHEN 'view' THEN 'kor' WHEN 'error' THEN 'jpn' WHEN 'signup' THEN 'rus' ELSE 'xxx' END) AS codes FROM u), p AS (SELECT user_id, codes, list_filter(['korean', 'cjk', 'eastSlavic'], lambda g: list_contains(codes, CASE g WHEN 'korean' THEN 'kor' WHEN 'cjk' THEN 'jpn' ELSE 'rus' END)) AS packs FROM c)
    SELECT user_id, CASE WHEN len(packs) = 0 AND list_contains(codes, 'eng') THEN ['english'] ELSE packs END AS packs FROM p""")
def language_packs(spark, sf_dir):
    kind = F.col("event_type")
    code = F.when(kind == "click", "eng").when(kind == "view", "kor").when(kind == "error", "jpn").when(kind == "signup", "rus").otherwise("xxx")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(code).alias("codes")).select("user_id", S.language_packs(F.col("codes")).alias("packs"))
