"""Queries of the operators on regions, over boxes and words made from every line of all documents, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import regions
from quire.operators.rounds import dealt_once
from quire.plans.queries import LINES, _lines, query

_LN = f"{LINES}, ln AS (SELECT *, length(text) AS n FROM lines)"


def _ln(spark, sf_dir) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("n", F.length("text"))


def _words(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("doc_id", "line_no", "n", *more, F.posexplode(F.split("text", " ")).alias("ci", "w")).filter("w <> ''")


_WORDS = lambda of, more="": f"(SELECT doc_id, line_no, n{more}, k - 1 AS ci, w[k] AS w FROM (SELECT *, string_split(text, ' ') AS w FROM {of}) q, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k) r WHERE w[k] <> '')"

# reading order

_BOXES = f"""{_LN}, bx AS (SELECT doc_id, CAST(line_no // 10 AS INT) AS page, line_no AS box_id, CAST(n % 3 * 150 + n % 7 * 4 AS DOUBLE) AS x0, CAST(20 + line_no % 10 * 30 + n % 11 AS DOUBLE) AS y0, CAST(n % 3 * 150 + n % 7 * 4 + CASE WHEN n % 9 = 0 THEN 420 ELSE 100 + n % 60 END AS DOUBLE) AS x1, CAST(40 + line_no % 10 * 30 + n % 11 AS DOUBLE) AS y1, CASE n % 8 WHEN 0 THEN 'image_text' WHEN 1 THEN 'aside_text' ELSE 'text' END AS label FROM ln),
    wd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, box_id) - 1 AS nth FROM bx WHERE x1 - x0 >= 500 * 0.78), wm AS (SELECT doc_id, page, list((y0 + y1) / 2 ORDER BY nth) AS m FROM wd GROUP BY ALL),
    nb AS (SELECT b.*, CAST(CASE WHEN m IS NULL THEN 0 ELSE coalesce(list_position(list_transform(m, lambda v: (y0 + y1) / 2 < v), TRUE) - 1, len(m)) END AS INT) AS band FROM bx b LEFT JOIN wm USING (doc_id, page) WHERE x1 - x0 < 500 * 0.78),
    np AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, band ORDER BY x0, y0, box_id) AS i FROM nb),
    fo AS (SELECT doc_id, page, band, box_id, i, [{{'a': x0, 'b': x1}}] AS cols, 0 AS col FROM np WHERE i = 1
      UNION ALL SELECT doc_id, page, band, box_id, i, CASE WHEN best < 0 THEN list_append(cols, {{'a': x0, 'b': x1}}) ELSE list_transform(cols, lambda c, j: CASE WHEN j - 1 = best THEN {{'a': least(c.a, x0), 'b': greatest(c.b, x1)}} ELSE c END) END, CASE WHEN best < 0 THEN len(cols) ELSE best END FROM (
        SELECT *, CAST(CASE WHEN list_max(share) < 0.3 THEN -1 ELSE list_position(share, list_max(share)) - 1 END AS INT) AS best FROM (SELECT p.*, f.cols, list_transform(f.cols, lambda c: greatest(0, least(c.b, p.x1) - greatest(c.a, p.x0)) / greatest(1, least(c.b - c.a, p.x1 - p.x0))) AS share FROM fo f JOIN np p ON p.doc_id = f.doc_id AND p.page = f.page AND p.band = f.band AND p.i = f.i + 1) q) s),
    fc AS (SELECT doc_id, page, band, arg_max(cols, i) AS cols FROM fo GROUP BY ALL), pl AS (SELECT p.*, len(list_filter(list_transform(c.cols, lambda d, j: d.a < c.cols[f.col + 1].a OR (d.a = c.cols[f.col + 1].a AND j - 1 < f.col)), lambda v: v)) AS "column" FROM np p JOIN fo f USING (doc_id, page, band, box_id) JOIN fc c ON c.doc_id = p.doc_id AND c.page = p.page AND c.band = p.band),
    pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, band, "column" ORDER BY y0, x0, box_id) - 1 AS r FROM pl),
    un AS (SELECT doc_id, page, box_id, x0, y0, x1, y1, label, band * 2 AS k1, "column" AS k2, r AS k3, CASE WHEN label = 'image_text' THEN 'image-b' || band || '-c' || "column" || '-r' || r ELSE CASE WHEN label = 'aside_text' THEN 'aside' ELSE 'body' END || '-b' || band || '-c' || "column" END AS scope FROM pr
      UNION ALL SELECT doc_id, page, box_id, x0, y0, x1, y1, label, nth * 2 + 1, 0, 0, CASE WHEN label = 'image_text' THEN 'image-wide-' ELSE 'wide-' END || nth FROM wd),
    od AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY k1, k2, k3) - 1 AS INT) AS place FROM un)"""


def _boxes(spark, sf_dir) -> DataFrame:
    n, at = F.col("n"), F.col("line_no")
    x0, y0 = (n % 3 * 150 + n % 7 * 4).cast("double"), (20 + at % 10 * 30 + n % 11).cast("double")
    label = F.when(n % 8 == 0, "image_text").when(n % 8 == 1, "aside_text").otherwise("text")
    return _ln(spark, sf_dir).select("doc_id", F.floor(at / 10).cast("int").alias("page"), at.alias("box_id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.when(n % 9 == 0, 420).otherwise(100 + n % 60)).alias("x1"), (y0 + 20).alias("y1"), label.alias("label"), F.lit(500.0).alias("page_w"))


@query(f"WITH RECURSIVE {_BOXES} SELECT doc_id, page, box_id, place, scope FROM od")
def ordered_regions(spark, sf_dir):
    return regions.ordered_regions(_boxes(spark, sf_dir)).select("doc_id", "page", "box_id", "place", "scope")


@query(f"WITH RECURSIVE {_BOXES} SELECT doc_id, page, scope, min(place) AS place, arg_min(label, place) AS label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM od GROUP BY doc_id, page, scope, CASE WHEN label IN ('image_text', 'aside_text', 'vertical_text') THEN box_id END")
def compacted_regions(spark, sf_dir):
    return regions.compacted_regions(regions.ordered_regions(_boxes(spark, sf_dir)))


# readings

_RUBY = f"""{_LN}, ba AS (SELECT doc_id, CAST(line_no // 20 AS INT) AS page, line_no * 1000 AS line_no, translate(text, 'aeiou', '漢字日本語') AS text, 40.0::DOUBLE AS x0, 20.0::DOUBLE + line_no % 20 * 30 AS y0, 40.0::DOUBLE + n * 6 AS x1, 32.0::DOUBLE + line_no % 20 * 30 AS y1 FROM ln),
    wo AS (SELECT *, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY ci) AS BIGINT) - length(w) - 1 AS off FROM (SELECT doc_id, line_no, n, k - 1 AS ci, w[k] AS w FROM (SELECT *, string_split(text, ' ') AS w FROM ln) q, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k) r) z),
    ru AS (SELECT doc_id, CAST(line_no // 20 AS INT) AS page, CAST(line_no * 1000 + ci + 1 AS INT) AS line_no, translate(w, 'aeiourstn', 'かなひらがきさしの') AS text, 40.0::DOUBLE + off * 6 AS x0, 20.0::DOUBLE + line_no % 20 * 30 - 5 - n % 6 AS y0, 40.0::DOUBLE + (off + length(w)) * 6 AS x1, 20.0::DOUBLE + line_no % 20 * 30 - n % 6 + n % 4 AS y1 FROM wo WHERE w <> ''),
    li AS (SELECT * FROM ba UNION ALL SELECT * FROM ru), sm AS (SELECT *, trim(text, ' ') AS reading, length(regexp_replace(trim(text, ' '), '[^\\p{{L}}\\p{{N}}ぁ-ゟ゠-ヿー・]', '', 'g')) AS meant, length(regexp_replace(trim(text, ' '), '[^ぁ-ゟ゠-ヿー・]', '', 'g')) AS kana FROM li),
    mt AS (SELECT r.doc_id, r.page, r.line_no, r.reading, b.line_no AS base, b.text, b.x0, b.x1, r.x0 AS rx0, r.x1 AS rx1, b.y0 - r.y1 AS gap, b.x1 - b.x0 AS w, r.x1 - r.x0 AS rw, length(b.text) AS len FROM sm r JOIN li b ON b.doc_id = r.doc_id AND b.page = r.page AND b.line_no <> r.line_no AND regexp_matches(b.text, '\\p{{Han}}') AND b.x1 > b.x0
        WHERE length(reading) BETWEEN 1 AND 24 AND meant > 0 AND kana / meant >= 0.72 AND r.y1 - r.y0 <= (b.y1 - b.y0) * 0.72 AND b.y0 >= r.y0 AND b.y0 - r.y1 >= (r.y1 - r.y0) * -0.45 AND b.y0 - r.y1 <= (b.y1 - b.y0) * 0.8 AND greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) >= least(r.x1 - r.x0, b.x1 - b.x0) * 0.3),
    hi AS (SELECT *, list_filter(range(CAST(greatest(0, floor((rx0 - x0) / w * len) - 1) AS BIGINT), CAST(least(len, ceil((rx1 - x0) / w * len) + 1) AS BIGINT)), lambda i: x0 + (i + 0.5::DOUBLE) * w / len BETWEEN rx0 AND rx1 AND regexp_full_match(substring(text, i + 1, 1), '\\p{{Han}}')) AS h FROM mt),
    sp AS (SELECT *, list_min(h) AS a, list_max(h) + 1 AS z FROM hi WHERE len(h) > 0), se AS (SELECT *, least(a, greatest(a - length(regexp_extract(left(text, a), '\\p{{Han}}*$')), CAST(ceil((rx0 - rw * 0.2::DOUBLE - x0) / (w / len)) AS BIGINT) - 1)) AS s, greatest(z, least(z + length(regexp_extract(substring(text, z + 1), '^\\p{{Han}}*')), CAST(floor((rx1 + rw * 0.2::DOUBLE - x0) / (w / len)) AS BIGINT) + 1)) AS e, abs(gap) + abs((rx0 + rx1 - x0 - x1) / 2) * 0.08::DOUBLE AS score FROM sp),
    rd AS (SELECT doc_id, page, line_no, reading, base, CAST(s AS INT) AS start, CAST(e AS INT) AS stop FROM se QUALIFY row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY score, base) = 1)"""


def _ruby(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    # a document's lines are in one part before they become words, so the window over words, and what words meet, need no shuffle; a fixed number, or parts of two uses would differ
    spark = dealt_once(spark)
    rows, n, y = _lines(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").withColumn("n", F.length("text")), F.col("n"), 20.0 + F.col("line_no") % 20 * 30
    page = F.floor(F.col("line_no") / 20).cast("int").alias("page")
    base = rows.select("doc_id", page, (F.col("line_no") * 1000).alias("line_no"), F.translate("text", "aeiou", "漢字日本語").alias("text"), F.lit(40.0).alias("x0"), y.alias("y0"), (40.0 + n * 6).alias("x1"), (y + 12).alias("y1"))
    kana = F.translate("text", "aeiourstn", "かなひらがきさしの")  # of a line at once: what looks at a word would translate it again
    words = rows.select("doc_id", "line_no", "n", F.posexplode(F.split(kana, " ")).alias("ci", "w")).withColumn("off", F.sum(F.length("w") + 1).over(Window.partitionBy("doc_id", "line_no").orderBy("ci")) - F.length("w") - 1).filter("w <> ''")
    above = words.select("doc_id", page, (F.col("line_no") * 1000 + F.col("ci") + 1).alias("line_no"), F.col("w").alias("text"), (40.0 + F.col("off") * 6).alias("x0"), (y - 5 - n % 6).alias("y0"), (40.0 + (F.col("off") + F.length("w")) * 6).alias("x1"), (y - n % 6 + n % 4).alias("y1"))
    return base.unionByName(above)


@query(f"WITH {_RUBY} SELECT * FROM rd")
def readings(spark, sf_dir):
    return regions.readings(_ruby(spark, sf_dir))


@query(f"""WITH RECURSIVE {_RUBY}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, base ORDER BY start, stop, line_no, reading) AS i FROM rd),
    f AS (SELECT doc_id, page, base, 0::BIGINT AS i, 0 AS pos, '' AS plain, '' AS html FROM (SELECT DISTINCT doc_id, page, base FROM rd) q UNION ALL SELECT f.doc_id, f.page, f.base, o.i, CASE WHEN o.start < pos THEN pos ELSE o.stop END, CASE WHEN o.start < pos THEN plain ELSE plain || substring(l.text, pos + 1, o.stop - pos) || '（' || o.reading || '）' END,
        CASE WHEN o.start < pos THEN html ELSE html || replace(replace(replace(substring(l.text, pos + 1, o.start - pos), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '<ruby>' || replace(replace(replace(substring(l.text, o.start + 1, o.stop - o.start), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '<rt>' || replace(replace(replace(o.reading, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</rt></ruby>' END FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.base = f.base AND o.i = f.i + 1 JOIN li l ON l.doc_id = f.doc_id AND l.page = f.page AND l.line_no = f.base)
    SELECT f.doc_id, f.page, f.base AS line_no, plain || substring(l.text, pos + 1) AS text, html || replace(replace(replace(substring(l.text, pos + 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM f JOIN li l ON l.doc_id = f.doc_id AND l.page = f.page AND l.line_no = f.base QUALIFY row_number() OVER (PARTITION BY f.doc_id, f.page, f.base ORDER BY i DESC) = 1""")
def with_readings(spark, sf_dir):
    rows = _ruby(spark, sf_dir)
    return regions.with_readings(rows, regions.readings(rows))


# pieces of one image

_IMAGES = f"""{_LN}, im AS (SELECT doc_id, CAST(line_no // 8 AS INT) AS page, line_no AS box_id, 40.0::DOUBLE + line_no % 2 * 200 + CASE WHEN n % 6 = 0 THEN 3 ELSE 0 END AS x0, 50.0::DOUBLE + line_no % 8 // 2 * 40 AS y0, 240.0::DOUBLE + line_no % 2 * 200 AS x1, 90.0::DOUBLE + line_no % 8 // 2 * 40 + CASE WHEN n % 5 = 0 THEN 30 ELSE 0 END AS y1, n, text, line_no FROM ln),
    gl AS (SELECT doc_id, CAST(line_no // 8 AS INT) AS page, x0 + 10 + ci % 10 * 15 AS x0, x0 + 10 + ci % 10 * 15 + length(w) * 2 AS x1, CASE WHEN n % 4 = 0 THEN y0 + 10 ELSE 400 END AS y0, CASE WHEN n % 4 = 0 THEN y0 + 18 ELSE 408 END AS y1 FROM {_WORDS('im', ', x0, y0')} g),
    nt AS (SELECT i.*, (x1 - x0) * (y1 - y0) AS area, (SELECT count(*) FROM gl g WHERE g.doc_id = i.doc_id AND g.page = i.page AND (g.x0 + g.x1) / 2 > i.x0 AND (g.x0 + g.x1) / 2 < i.x1 AND (g.y0 + g.y1) / 2 > i.y0 AND (g.y0 + g.y1) / 2 < i.y1) AS k FROM im i),
    pa AS (SELECT a.doc_id, a.page, a.box_id AS a, b.box_id AS b, least(a.k, b.k) >= 3 AS texts, (abs(a.x0 - b.x0) <= 2 AND abs(a.x1 - b.x1) <= 2 AND (abs(a.y1 - b.y0) <= 2 OR abs(b.y1 - a.y0) <= 2)) OR (abs(a.y0 - b.y0) <= 2 AND abs(a.y1 - b.y1) <= 2 AND (abs(a.x1 - b.x0) <= 2 OR abs(b.x1 - a.x0) <= 2)) AS beside,
        greatest(a.area, b.area) < 500 * 500 * 0.5 AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= least(a.area, b.area) * 0.1 AND greatest(a.k, b.k) < 3 AS laid FROM nt a JOIN nt b ON a.doc_id = b.doc_id AND a.page = b.page AND a.box_id <> b.box_id),
    re AS (SELECT doc_id, page, box_id AS a, box_id AS b FROM nt UNION SELECT r.doc_id, r.page, r.a, p.b FROM re r JOIN pa p ON p.doc_id = r.doc_id AND p.page = r.page AND p.a = r.b WHERE (beside OR laid) AND NOT (beside AND texts))"""


@query(f"WITH RECURSIVE {_IMAGES} SELECT doc_id, page, a AS box_id, min(b) AS group_id, EXISTS (SELECT 1 FROM pa WHERE pa.doc_id = re.doc_id AND pa.page = re.page AND pa.a = re.a AND laid AND NOT beside) AS overlay FROM re GROUP BY doc_id, page, a")
def image_pieces(spark, sf_dir):
    n, at = F.col("n"), F.col("line_no")
    x0, y0 = 40.0 + at % 2 * 200 + F.when(n % 6 == 0, 3).otherwise(0), 50.0 + F.floor(at % 8 / 2) * 40
    page = F.floor(at / 8).cast("int").alias("page")
    rows = _ln(spark, sf_dir).withColumns({"x0": x0, "y0": y0})
    images = rows.select("doc_id", page, at.alias("box_id"), "x0", "y0", (240.0 + at % 2 * 200).alias("x1"), (F.col("y0") + 40 + F.when(n % 5 == 0, 30).otherwise(0)).alias("y1"), F.lit(500.0).alias("page_w"), F.lit(500.0).alias("page_h"))
    w0, v0 = F.col("x0") + 10 + F.col("ci") % 10 * 15, F.when(n % 4 == 0, F.col("y0") + 10).otherwise(400.0)
    glyphs = _words(rows, "x0", "y0").select("doc_id", page, w0.alias("x0"), (w0 + F.length("w") * 2).alias("x1"), v0.alias("y0"), (v0 + 8).alias("y1"))
    return regions.image_pieces(images, glyphs)


# labels and numbers

_LABELS = f"""{_LN}, bo AS (SELECT doc_id, CAST(line_no // 9 AS INT) AS page, line_no AS box_id, 40.0::DOUBLE + line_no % 3 * 130 + CASE WHEN n % 13 = 0 THEN 5 ELSE 0 END AS x0, 100.0::DOUBLE + line_no % 3 * 130 + CASE WHEN n % 13 = 0 THEN 5 ELSE 0 END AS x1, 30.0::DOUBLE + line_no % 9 // 3 * 24 + CASE WHEN n % 17 = 0 THEN 9 ELSE 0 END AS y0, 50.0::DOUBLE + line_no % 9 // 3 * 24 + CASE WHEN n % 17 = 0 THEN 9 ELSE 0 END AS y1, n, text, line_no FROM ln),
    wo AS (SELECT doc_id, page, CAST(line_no * 10000 + ci AS INT) AS ci, w, x0 + 5 + ci % 6 * 20 AS x0, x0 + 5 + ci % 6 * 20 + length(w) * 2 AS x1, y0 + 2 + ci // 6 % 2 * 8 AS y0, y0 + 9 + ci // 6 % 2 * 8 AS y1, y0 + 9 + ci // 6 % 2 * 8 AS oy, 7.0::DOUBLE AS size FROM {_WORDS('bo', ', page, x0, y0')} g),
    bp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, box_id) AS i FROM bo),
    fo AS (SELECT doc_id, page, box_id, i, [{{'a': y0, 'b': y1}}] AS rs, 0 AS r FROM bp WHERE i = 1 UNION ALL SELECT doc_id, page, box_id, i, CASE WHEN p IS NULL OR p = 0 THEN list_append(rs, {{'a': y0, 'b': y1}}) ELSE rs END, CAST(CASE WHEN p IS NULL OR p = 0 THEN len(rs) ELSE p - 1 END AS INT) FROM (SELECT b.*, f.rs, list_position(list_transform(f.rs, lambda c: abs(c.a - b.y0) <= 2 AND abs(c.b - b.y1) <= 2), TRUE) AS p FROM fo f JOIN bp b ON b.doc_id = f.doc_id AND b.page = f.page AND b.i = f.i + 1) q),
    ro AS (SELECT doc_id, page, r, list({{'x0': x0, 'x1': x1, 'id': box_id}} ORDER BY x0, x1, y0, y1, box_id) AS cells, arg_min(y0, (y0, x0, box_id)) AS y0, arg_min(y1, (y0, x0, box_id)) AS y1 FROM bp JOIN (SELECT doc_id, page, box_id, r FROM fo) f USING (doc_id, page, box_id) GROUP BY ALL),
    rl AS (SELECT *, lag(cells) OVER w AS pc, lag(y1) OVER w AS py FROM ro WINDOW w AS (PARTITION BY doc_id, page ORDER BY r)), rg AS (SELECT *, sum(CASE WHEN len(cells) = len(pc) AND y0 - py <= 6 AND len(list_filter(list_transform(cells, lambda c, k: abs(c.x0 - pc[k].x0) <= 2 AND abs(c.x1 - pc[k].x1) <= 2), lambda v: v)) = len(cells) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY r) AS g FROM rl),
    rb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, g ORDER BY r) - 1 AS k, arg_min(cells, r) OVER (PARTITION BY doc_id, page, g) AS labels, arg_min(y0, r) OVER (PARTITION BY doc_id, page, g) AS top, arg_max(y1, r) OVER (PARTITION BY doc_id, page, g) AS bottom FROM rg QUALIFY count(*) OVER (PARTITION BY doc_id, page, g) >= 2),
    fa AS (SELECT r.doc_id, r.page, g, labels, coalesce(max(w.x1) + 6, labels[-1].x1 + 60) AS far, row_number() OVER (PARTITION BY r.doc_id, r.page ORDER BY g) - 1 AS table_no FROM rb r LEFT JOIN wo w ON w.doc_id = r.doc_id AND w.page = r.page AND (w.y0 + w.y1) / 2 > top AND (w.y0 + w.y1) / 2 < bottom AND w.x0 >= labels[-1].x1 WHERE k = 0 GROUP BY r.doc_id, r.page, g, labels),
    cs AS (SELECT r.doc_id, r.page, table_no, r.k, c - 1 AS col, r.y0 AS top, r.y1 AS bottom, cells[c].x0 AS la, cells[c].x1 AS lb, f.labels[c].x1 AS va, coalesce(f.labels[c + 1].x0, far) AS vb FROM rb r JOIN fa f USING (doc_id, page, g), LATERAL (SELECT unnest(range(1, len(cells) + 1)) AS c) z),
    ar AS (SELECT doc_id, page, table_no, k, col, top, bottom, 'label' AS kind, la AS a, lb AS b FROM cs UNION ALL SELECT doc_id, page, table_no, k, col, top, bottom, 'value', va, vb FROM cs),
    hw AS (SELECT a.doc_id, a.page, table_no, k, col, kind, w, oy, size, w.x0, w.x1, ci, lag(oy) OVER o AS po, lag(w.x1) OVER o AS px FROM ar a JOIN wo w ON w.doc_id = a.doc_id AND w.page = a.page AND (w.x0 + w.x1) / 2 BETWEEN a AND b AND (w.y0 + w.y1) / 2 BETWEEN top AND bottom WINDOW o AS (PARTITION BY a.doc_id, a.page, table_no, k, col, kind ORDER BY oy, w.x0, ci)),
    tx AS (SELECT doc_id, page, table_no, k, col, kind, trim(string_agg(CASE WHEN abs(oy - po) >= size * 0.5 OR x0 - px > size * 0.2 THEN ' ' ELSE '' END || w, '' ORDER BY oy, x0, ci), ' ') AS t FROM hw GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_LABELS} SELECT c.doc_id, c.page, CAST(c.table_no AS INT) AS table_no, CAST(c.k AS INT) AS "row", CAST(c.col AS INT) AS col, coalesce(max(t) FILTER (kind = 'label'), '') AS label, coalesce(max(t) FILTER (kind = 'value'), '') AS value FROM cs c LEFT JOIN tx t ON t.doc_id = c.doc_id AND t.page = c.page AND t.table_no = c.table_no AND t.k = c.k AND t.col = c.col GROUP BY c.doc_id, c.page, c.table_no, c.k, c.col""")
def label_tables(spark, sf_dir):
    n, at = F.col("n"), F.col("line_no")
    x0, y0 = 40.0 + at % 3 * 130 + F.when(n % 13 == 0, 5).otherwise(0), 30.0 + F.floor(at % 9 / 3) * 24 + F.when(n % 17 == 0, 9).otherwise(0)
    rows = _ln(spark, sf_dir).withColumns({"page": F.floor(at / 9).cast("int"), "x0": x0, "y0": y0})
    boxes = rows.select("doc_id", "page", at.alias("box_id"), "x0", "y0", (F.col("x0") + 60).alias("x1"), (F.col("y0") + 20).alias("y1"))
    w0, oy = F.col("x0") + 5 + F.col("ci") % 6 * 20, F.col("y0") + 9 + F.floor(F.col("ci") / 6) % 2 * 8
    words = _words(rows, "page", "x0", "y0").select("doc_id", "page", (at * 10000 + F.col("ci")).alias("ci"), "w", w0.alias("x0"), (w0 + F.length("w") * 2).alias("x1"), (oy - 7).alias("y0"), oy.alias("y1"), oy.alias("oy"), F.lit(7.0).alias("size"))
    return regions.label_tables(boxes, words)


_NUMBERS = f"""{_LN}, gl AS (SELECT doc_id, CAST(line_no // 15 AS INT) AS page, line_no AS "row", ci, w AS c, 40.0::DOUBLE + ci * 25 AS x0, 40.0::DOUBLE + ci * 25 + length(w) * 3 AS x1, 10.0::DOUBLE AS size FROM {_WORDS('ln')} g
      UNION ALL SELECT doc_id, CAST(line_no // 15 AS INT), line_no, 99999 + k, substring(CAST(n AS VARCHAR), k, 1), 454.0::DOUBLE - (length(CAST(n AS VARCHAR)) - k) * 6 + CASE WHEN n % 5 = 0 THEN 9 ELSE n % 3 * 0.5::DOUBLE END, 460.0::DOUBLE - (length(CAST(n AS VARCHAR)) - k) * 6 + CASE WHEN n % 5 = 0 THEN 9 ELSE n % 3 * 0.5::DOUBLE END, 10.0 FROM ln, LATERAL (SELECT unnest(range(1, length(CAST(n AS VARCHAR)) + 1)) AS k) r),
    ne AS (SELECT *, regexp_matches(c, '^[0-9]') AS d, lag(x1) OVER w AS px, lead(x0) OVER w AS nx, lag(size) OVER w AS ps, lag(regexp_matches(c, '^[0-9]')) OVER w AS pd FROM gl WINDOW w AS (PARTITION BY doc_id, page, "row" ORDER BY ci)), rn AS (SELECT *, sum(CASE WHEN d AND pd AND x0 - px < ps * 0.3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, "row" ORDER BY ci) AS run FROM ne),
    cd AS (SELECT doc_id, page, "row", min(ci) AS f, max(ci) AS l, arg_min(size, ci) AS size, arg_max(x1, ci) AS x1 FROM rn WHERE d GROUP BY doc_id, page, "row", run HAVING count(*) <= 4 AND coalesce(arg_min(x0, ci) - arg_min_null(px, ci) > arg_min(size, ci) * 0.5, TRUE) AND coalesce(arg_max_null(nx, ci) - arg_max(x1, ci) > arg_min(size, ci) * 3, TRUE)),
    ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY "row", f) AS i FROM cd), al AS (SELECT a.doc_id, a.page, a.i AS a, b.i AS b FROM ok a JOIN ok b ON a.doc_id = b.doc_id AND a.page = b.page AND abs(a.x1 - b.x1) < greatest(a.size, b.size) * 0.4), ag AS (SELECT doc_id, page, a AS i, list(b ORDER BY b) AS bs FROM al GROUP BY ALL),
    st AS (SELECT doc_id, page, 0::BIGINT AS i, []::BIGINT[] AS used FROM (SELECT DISTINCT doc_id, page FROM ok) q UNION ALL SELECT s.doc_id, s.page, g.i, CASE WHEN list_contains(used, g.i) OR len(list_filter(bs, lambda b: NOT list_contains(used, b))) < 4 THEN used ELSE list_concat(used, list_filter(bs, lambda b: NOT list_contains(used, b))) END FROM st s JOIN ag g ON g.doc_id = s.doc_id AND g.page = s.page AND g.i = s.i + 1)"""


@query(f"""WITH RECURSIVE {_NUMBERS} SELECT o.doc_id, o.page, "row", CAST(f AS INT) AS "first", CAST(l AS INT) AS "last" FROM ok o JOIN (SELECT doc_id, page, arg_max(used, i) AS used FROM st GROUP BY ALL) u ON u.doc_id = o.doc_id AND u.page = o.page AND list_contains(used, o.i)""")
def number_columns(spark, sf_dir):
    n, at = F.col("n"), F.col("line_no")
    rows = _ln(spark, sf_dir)
    page = F.floor(at / 15).cast("int").alias("page")
    text = _words(rows).select("doc_id", page, at.alias("row"), "ci", F.col("w").alias("c"), (40.0 + F.col("ci") * 25).alias("x0"), (40.0 + F.col("ci") * 25 + F.length("w") * 3).alias("x1"), F.lit(10.0).alias("size"))
    digits = rows.withColumn("t", n.cast("string")).select("doc_id", "line_no", "n", "t", F.posexplode(F.split("t", "")).alias("k", "c"))
    x0 = 454.0 - (F.length("t") - 1 - F.col("k")) * 6 + F.when(n % 5 == 0, 9).otherwise(n % 3 * 0.5)
    return regions.number_columns(text.unionByName(digits.select("doc_id", page, at.alias("row"), (100_000 + F.col("k")).alias("ci"), "c", x0.alias("x0"), (x0 + 6).alias("x1"), F.lit(10.0).alias("size"))))
