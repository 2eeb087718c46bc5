"""The query of line joins, on lines with varied geometry made from whole documents, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import joins
from quire.plans.queries import _END, _MARK, CORE, LINES, _lines, query

#: Lines of up to four words of each line, so that documents have enough of them, with places that follow from their lengths.
_SET = f"""{LINES}, cut AS (SELECT doc_id, line_no, string_split(text, ' ') AS w FROM lines), four AS (SELECT doc_id, line_no, k, array_to_string(w[k * 4 + 1 : k * 4 + 4], ' ') AS text FROM cut, LATERAL (SELECT unnest(range(0, (len(w) + 3) // 4)) AS k) r),
    numbered AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS INT) AS line_no, text || CASE WHEN length(text) % 9 = 0 THEN '-' ELSE '' END AS text FROM four),
    geo AS (SELECT doc_id, line_no, CAST(line_no // 20 AS INT) AS page, line_no // 10 % 2 AS grp, text, n, CASE WHEN n % 13 = 0 THEN 14.0 ELSE 10.0 END AS size, 40.0 + CASE WHEN n % 7 = 0 THEN 12 WHEN n % 11 = 0 THEN 30 ELSE 0 END AS x0, 40.0 + n * 5 AS x1, 30.0 + line_no % 10 * 14 + CASE WHEN n % 10 = 0 THEN 9 ELSE 0 END AS oy,
        CASE WHEN n % 12 = 0 THEN 700 ELSE 400 END AS weight, CASE WHEN n % 29 = 0 THEN 0.5 ELSE 0.0 END AS angle, 40.0 AS l, 190.0 AS r, 14.0 AS pitch, line_no // 10 % 3 = 0 AS just, 10.0 AS body, 2.5 AS space FROM (SELECT *, length(text) AS n FROM numbered) q)"""
_LABEL = r"^[^\s:：.!?。][^:：.!?。]{0,18}\s*[:：]\s+\S"
_RATIO = r"^[^:：]*[0-9]\s*[:：]\s*[0-9]"
_PART = "|".join(sorted(S.PARTICLES, key=len, reverse=True))
_STEM = lambda t: f"regexp_replace({t}, '^(.+?)(?:{_PART})$', '\\1')"
_core = lambda t: CORE.replace("raw", t)


def _fours(text: Column) -> Column:
    """The pieces of four words of a line, which is split once, not for each of its pieces."""
    places = lambda w: F.sequence(F.lit(0), F.floor((F.size(w) + 3) / 4).cast("int") - 1)
    return S.let(F.split(text, " "), lambda w: F.transform(places(w), lambda k: F.array_join(F.slice(w, k * 4 + 1, 4), " ")))


def _rows(spark, sf_dir) -> DataFrame:
    four = _fours(F.col("text"))
    # pieces are numbered through each document by the lines and pieces before them
    cut = _lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(four).alias("k", "text"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "k")) - 1
    rows = cut.select("doc_id", number.alias("line_no"), F.concat("text", F.when(F.length("text") % 9 == 0, "-").otherwise("")).alias("text")).withColumn("n", F.length("text"))
    n, at = F.col("n"), F.col("line_no")
    return rows.select(
        "doc_id", "line_no", F.floor(at / 20).cast("int").alias("page"), (F.floor(at / 10) % 2).alias("grp"), "text", F.when(n % 13 == 0, 14.0).otherwise(10.0).alias("size"), (40.0 + F.when(n % 7 == 0, 12).when(n % 11 == 0, 30).otherwise(0)).alias("x0"), (40.0 + n * 5).alias("x1"),
        (30.0 + at % 10 * 14 + F.when(n % 10 == 0, 9).otherwise(0)).alias("oy"), F.when(n % 12 == 0, 700).otherwise(400).alias("weight"), F.when(n % 29 == 0, 0.5).otherwise(0.0).alias("angle"), F.lit(40.0).alias("left"), F.lit(190.0).alias("right"), F.lit(14.0).alias("pitch"),
        (F.floor(at / 10) % 3 == 0).alias("justified"), F.lit(10.0).alias("body"), F.lit(2.5).alias("space"),
    )


#: What breaks lines whatever the widths say.
_BRK = rf"""pr AS (SELECT *, lag(text) OVER w AS pt, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(oy) OVER w AS poy, lag(size) OVER w AS ps, lag(weight) OVER w AS pw, lag(angle) OVER w AS pa, lag(page) OVER w AS pp, lag(grp) OVER w AS pg, lag(just) OVER w AS pj, lag(oy, 2) OVER w AS qoy, lag(size, 2) OVER w AS qs, lag(page, 2) OVER w AS qp, lag(grp, 2) OVER w AS qg, lead(x0) OVER w AS nx0, lead(oy) OVER w AS noy, lead(size) OVER w AS ns, lead(page) OVER w AS np, lead(grp) OVER w AS ng FROM geo WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    b AS (SELECT *, page = pp AND grp = pg AS same, oy - poy AS step, regexp_matches(pt, '{_END}') AS ended, regexp_matches(text, '{_MARK}') AS item, greatest(size, ps) AS big, least(size, ps) AS small, split_part(text, ' ', 1) AS h, split_part(pt, ' ', 1) AS ph, x0 - l AS ind, CASE WHEN np = page AND ng = grp THEN nx0 - l ELSE 0 END AS nind,
        CASE WHEN abs(ps - size) < 0.5 AND abs(size - body) > body * 0.12 THEN pitch * size / body ELSE pitch END AS base, least(CASE WHEN qp = pp AND qg = pg AND abs(qs - ps) < 0.5 AND poy > qoy THEN poy - qoy END, CASE WHEN np = page AND ng = grp AND abs(ns - size) < 0.5 AND noy > oy THEN noy - oy END) AS around FROM pr WHERE pt IS NOT NULL),
    m AS (SELECT *, same AND step > 0 AND step <= pitch * 1.15 AND NOT ended AND NOT item AND x0 - CASE WHEN px0 - l > ps * 0.3 THEN px0 ELSE l END > size * 2.5 AND NOT (big > body * 1.5 AND small >= body * 0.8 AND big > small * 1.3) AS missing FROM b),
    k AS (SELECT *, CASE WHEN missing THEN NULL WHEN regexp_matches(pt, '([.·…‥・_][ ]*){{4,}}([0-9]{{1,4}}|[ivxlcIVXLC]{{1,6}})[ ]*$') THEN 'end of a contents entry' WHEN abs(angle) >= 0.3 OR abs(pa) >= 0.3 THEN 'turned text' WHEN NOT same AND page = pp AND step > big * 2.2 THEN 'gap between sections' WHEN abs(size - ps) > big * 0.12 THEN 'size' WHEN abs(weight - pw) >= 250 AND (ended OR r - px1 > ps) THEN 'weight'
        WHEN same AND step > coalesce(greatest(base, around), base) + greatest(size * 0.3, pitch * 0.15) THEN 'gap' WHEN same AND step < 0 THEN 'going back' WHEN ind > size * 0.6 AND NOT (same AND abs(x0 - px0) < size * 0.35 AND px0 - l > size * 0.3) AND NOT (nind > size * 0.6 AND abs(nind - ind) < size * 0.3) THEN 'indent'
        WHEN regexp_matches(pt, '{_LABEL}') AND NOT regexp_matches(pt, '{_RATIO}') AND regexp_matches(text, '{_LABEL}') AND NOT regexp_matches(text, '{_RATIO}') THEN 'labels' WHEN same AND regexp_full_match(h, '[^\p{{L}}\p{{N}}\s]') AND h = ph AND contains(text, ' ') THEN 'same sign' WHEN item AND contains(text, ' ') AND (ended OR ends_with(pt, ':') OR r - px1 > size * 2) THEN 'list mark' END AS brk FROM m)"""


@query(rf"""WITH {_SET}, tok AS (SELECT doc_id, len(p) AS n, i - 1 AS pos, p[i] AS raw FROM (SELECT doc_id, string_split(text, ' ') AS p FROM geo) q, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) r), t AS (SELECT doc_id, {CORE} AS token, count(*) AS k FROM tok WHERE pos BETWEEN 1 AND n - 2 GROUP BY ALL),
    words AS (SELECT doc_id, base, sum(k) AS n FROM (SELECT doc_id, token AS base, k FROM t WHERE token <> '' UNION ALL SELECT DISTINCT doc_id, left(token, length(token) - length(p)), k FROM t, (SELECT unnest([{', '.join(f"'{p}'" for p in S.PARTICLES)}]) AS p) s WHERE ends_with(token, p) AND length(token) > length(p)) u GROUP BY ALL),
    {_BRK},
    c AS (SELECT *, {_core("regexp_extract(pt, '([^ ]*)$', 1)")} AS a, {_core("h")} AS bb, (x1 - x0) / greatest(length(text), 1) AS chr, r - px1 AS slack, regexp_matches(pt, '[A-Za-zÀ-ɏ][-‐]$') AND regexp_matches(text, '^[A-Za-zÀ-ɏ]') AS hy FROM k),
    j AS (SELECT *, {_STEM("CASE WHEN hy THEN regexp_replace(a, '[-‐]$', '') ELSE a END || bb")} AS joined, regexp_replace(a, '[-‐]$', '') || '-' || bb AS hyphened, {_STEM("a")} AS sa, {_STEM("bb")} AS sb FROM c),
    e AS (SELECT j.*, coalesce(w1.n, 0) > 0 AS hj, coalesce(w2.n, 0) > 0 AS hh, 3.0 - CASE WHEN regexp_matches(pt, '[一-鿿぀-ヿ㐀-䶿]$') AND regexp_matches(text, '^[一-鿿぀-ヿ㐀-䶿]') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(text, '^[.,!?;:)\]}}」』》〉”’…]') THEN -6 WHEN regexp_matches(pt, '[.!?…。！？]$') AND regexp_matches(text, '^\p{{L}}') THEN 3 ELSE 0 END + CASE WHEN length(a) > 1 AND length(bb) > 1 AND w3.n > 0 AND w4.n > 0 THEN 1.5 ELSE 0 END AS score,
        same AND ps > body * 1.15 AND abs(size - ps) <= big * 0.12 AND NOT ended AS title FROM j LEFT JOIN words w1 ON w1.doc_id = j.doc_id AND w1.base = joined LEFT JOIN words w2 ON w2.doc_id = j.doc_id AND w2.base = hyphened LEFT JOIN words w3 ON w3.doc_id = j.doc_id AND w3.base = sa LEFT JOIN words w4 ON w4.doc_id = j.doc_id AND w4.base = sb),
    o AS (SELECT *, CASE WHEN missing THEN 1 WHEN brk IS NOT NULL THEN 2 WHEN pj AND NOT title AND slack >= ps * 0.2 AND (slack >= chr OR ended) THEN 3 WHEN NOT pj AND NOT title AND slack >= length(h) * chr + space + ps * 0.1 THEN 4 WHEN hy AND hj THEN 5 WHEN hy AND hh THEN 6 WHEN hy THEN 7 WHEN length(joined) >= 2 AND a <> '' AND bb <> '' AND hj THEN 8 ELSE 9 END AS rule,
        CASE WHEN NOT same AND ended THEN 0.6 WHEN same AND regexp_matches(pt, '[.!?][”’"'']?$') AND (NOT pj OR slack < ps * 0.2) AND score > 0 THEN 0.7 ELSE 1 END AS doubt FROM e)
    SELECT doc_id, line_no, CASE rule WHEN 1 THEN 'space' WHEN 2 THEN 'para' WHEN 3 THEN 'para' WHEN 4 THEN 'para' WHEN 5 THEN 'hyphen-drop' WHEN 6 THEN 'none' WHEN 7 THEN 'hyphen-drop' WHEN 8 THEN 'none' ELSE CASE WHEN score > 0 THEN 'space' ELSE 'none' END END AS kind,
        CAST(CASE rule WHEN 1 THEN 0.3 WHEN 2 THEN 0.97 WHEN 3 THEN CASE WHEN ended OR weight - pw >= 100 THEN 0.95 ELSE 0.78 END WHEN 4 THEN CASE WHEN ended OR slack > ps * 3 THEN 0.93 ELSE 0.72 END WHEN 5 THEN 0.92 WHEN 6 THEN 0.92 WHEN 7 THEN 0.6 WHEN 8 THEN 0.97 ELSE round(least(1 / (1 + exp(-abs(score))), doubt), 3) END AS DOUBLE) AS conf,
        CASE rule WHEN 1 THEN 'characters may be missing' WHEN 2 THEN brk WHEN 3 THEN 'short line of a justified column' WHEN 4 THEN 'the next word had room' WHEN 5 THEN 'known without its hyphen' WHEN 6 THEN 'known with its hyphen' WHEN 7 THEN 'hyphen' WHEN 8 THEN 'known in one piece' ELSE 'evidence' END AS reason FROM o""")
def line_joins(spark, sf_dir):
    return joins.line_joins(_rows(spark, sf_dir))


@query(f"""WITH {_SET}, w AS (SELECT *, lag(size) OVER p AS ps, lag(x0) OVER p AS px0, lag(oy) OVER p AS poy, lag(pitch) OVER p AS pp FROM geo WINDOW p AS (PARTITION BY doc_id, page, grp ORDER BY oy, line_no)),
    r AS (SELECT *, sum(CASE WHEN coalesce(abs(ps - size) < ps * 0.08 AND abs(px0 - x0) < ps * 2.5 AND abs(oy - poy) < greatest(pp, ps * 1.2) * 1.6, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, grp ORDER BY oy, line_no) AS run FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, grp, run ORDER BY oy, line_no) AS i FROM r),
    b AS (SELECT a.doc_id, a.line_no, a.size, a.r, a.l, count(*) AS n, max(q.x1) AS edge, list([q.x1, q.size]) AS ends FROM o a JOIN o q ON q.doc_id = a.doc_id AND q.page = a.page AND q.grp = a.grp AND q.run = a.run AND abs(q.i - a.i) <= 4 GROUP BY ALL), f AS (SELECT *, len(list_filter(ends, lambda e: e[1] >= edge - e[2])) AS k FROM b)
    SELECT doc_id, line_no, CAST(edge AS DOUBLE) AS local_right FROM f WHERE n >= 3 AND edge <= r - size * 2 AND k >= 2 AND k >= n * 0.6 AND edge - l >= (r - l) * 0.35""")
def local_edges(spark, sf_dir):
    return joins.local_edges(_rows(spark, sf_dir))


_MID = "'" + "', '".join(joins.STRONG) + "'"


@query(rf"""WITH {_SET}, {_BRK}, p AS (SELECT *, (x1 - x0) / greatest(length(text), 1) AS chr, r - px1 AS slack, {_core("h")} AS core FROM k WHERE brk IS NULL),
    n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (slack >= chr + space + ps * 0.1 AND slack < length(h) * chr + space + ps * 0.1 AND NOT ended) AS word_only, count(*) FILTER (slack >= chr * 0.95) AS roomy, count(*) FILTER (core IN ({_MID}) OR regexp_matches(core, '^({'|'.join(joins.ENDINGS)})') OR regexp_matches(h, '^[가-힣][.,!?]')) AS mid_word FROM p WHERE chr > 0 GROUP BY doc_id)
    SELECT doc_id, CASE WHEN mid_word >= 2 AND mid_word >= n * 0.04 THEN 'char' WHEN (word_only >= 2 AND word_only >= n * 0.08) OR roomy / n > 0.45 THEN 'word' ELSE 'char' END AS mode, n, word_only, roomy, mid_word FROM n""")
def wrap_modes(spark, sf_dir):
    return joins.wrap_modes(_rows(spark, sf_dir))
