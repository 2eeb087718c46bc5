"""Line flow as windows: seams between lines, paragraphs, lists, chapters, runs and tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import is_list_line, list_mark

END = r"""[.!?…。！？]["'”’)\]]*\z"""


def _order(*keys: str, by: str = "line_no") -> Window:
    return Window.partitionBy(*(keys or ("doc_id",))).orderBy(by)


def line_pairs(lines: DataFrame) -> DataFrame:
    """Each line with the ones around it: prev, prev2 and next text, and the line's right edge (6 points a character)."""
    w = _order()
    return lines.withColumns({"prev": F.lag("text", 1).over(w), "prev2": F.lag("text", 2).over(w), "next": F.lead("text").over(w), "x1": F.length("text") * 6.0}).withColumn("prev_x1", F.lag("x1").over(w))


def seams(lines: DataFrame, size: float = 10.0) -> DataFrame:
    """(doc_id, line_no, kind, conf, flagged, reason) of each line after its document's first.

    kind: para, hyphen-drop, none or space, by the first rule that holds: an empty line or a list mark begins a
    paragraph; so does a line after a short one that ends a sentence; a hyphen at a line's end before a small letter is
    dropped, before others kept; the rest are one text with a space. The measure of short is the document's right edge,
    less the first word of the line and a space.
    """
    right = lines.groupBy("doc_id").agg(F.max(F.length("text") * 6.0).alias("edge"))
    pairs = line_pairs(lines).filter(F.col("prev").isNotNull()).join(right, "doc_id")
    need = F.length(F.substring_index("text", " ", 1)) * 6.0 + 6.0 + 0.1 * size
    slack = F.col("edge") - F.col("prev_x1")
    rules: list[tuple[Column, str, float, str]] = [
        ((F.col("text") == "") | (F.col("prev") == ""), "para", 0.97, "blank"),
        (is_list_line("text"), "para", 0.97, "list mark"),
        ((slack >= need) & F.col("prev").rlike(END), "para", 0.93, "short line ends a sentence"),
        (F.col("prev").rlike(r"[\p{L}]-\z") & F.col("text").rlike(r"^\p{Ll}"), "hyphen-drop", 0.92, "hyphen before a small letter"),
        (F.col("prev").rlike(r"-\z"), "none", 0.92, "hyphen"),
        (slack >= need, "para", 0.72, "short line"),
        (F.col("prev").rlike(END), "space", 0.7, "sentence end in a full line"),
    ]
    first = _when([(r[0], F.lit(i)) for i, r in enumerate(rules)], F.lit(len(rules)))
    of = lambda i, rest: F.get(F.array(*(F.lit(r[i]) for r in rules), F.lit(rest)), F.col("rule"))
    out = pairs.withColumn("rule", first).withColumns({"kind": of(1, "space"), "conf": of(2, 0.95), "reason": of(3, "full line")})
    return out.select("doc_id", "line_no", "kind", "conf", (F.col("conf") < 0.8).alias("flagged"), "reason")


def _when(cases: list[tuple[Column, Column]], rest: Column) -> Column:
    out = rest
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def paragraphs(lines: DataFrame, joins: DataFrame) -> DataFrame:
    """(doc_id, para_no, first_line, n_lines, text): lines joined as their seams say, a new paragraph at each para.

    What stands behind a line follows from the next seam, so each line is a piece and a paragraph the pieces in a row.
    """
    kinds = lines.join(joins.select("doc_id", "line_no", "kind"), ["doc_id", "line_no"], "left")
    after = F.lead("kind").over(_order())
    piece = F.when(after == "space", F.concat("text", F.lit(" "))).when(after == "hyphen-drop", F.regexp_replace("text", "-\\z", "")).otherwise(F.col("text"))
    numbered = kinds.withColumn("piece", piece).withColumn("para_no", F.sum(F.when(F.col("kind") == "para", 1).otherwise(0)).over(_order()))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "piece")))
    return numbered.groupBy("doc_id", "para_no").agg(F.min("line_no").alias("first_line"), F.count("*").cast("int").alias("n_lines"), F.array_join(F.transform(rows, lambda r: r["piece"]), "").alias("text"))


def kept_whole(lines: DataFrame, paras: DataFrame) -> DataFrame:
    """(doc_id, same): whether a document's paragraphs have just its lines' characters, in order, spaces and seam hyphens aside."""
    bare = lambda c: F.regexp_replace(c, r"[\s-]", "")
    whole = lambda df, at: df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, bare("text").alias("t")))), lambda r: r["t"]), "").alias("t"))
    return whole(lines, "line_no").alias("a").join(whole(paras, "para_no").alias("b"), "doc_id").select("doc_id", (F.col("a.t") == F.col("b.t")).alias("same"))


def blank_lines(lines: DataFrame, pitch: str = "pitch", most: int = 3) -> DataFrame:
    """lines (doc_id, line_no, oy, pitch) with blanks: how many empty lines the gap above would hold, `most` at most; none where
    the pitch is 0 or unknown."""
    gap = F.try_divide(F.col("oy") - F.lag("oy").over(_order()), F.col(pitch)) - 1
    return lines.withColumn("blanks", F.when(gap >= 0.75, F.least(F.floor(gap + 0.5), F.lit(most))).otherwise(0).cast("int"))


def list_items(lines: DataFrame, reach: int = 3) -> DataFrame:
    """(doc_id, line_no, kind, key, value, starts) of lines that are list items.

    A line with a mark is an item only if one of the `reach` marked lines before or after it has the same key, and for
    numbers one more or less; an item starts a list if none before it does.
    """
    marked = lines.withColumn("mark", list_mark("text")).filter("mark is not null").select("doc_id", "line_no", "mark.kind", "mark.key", "mark.value")
    w = _order()

    def beside(at: int) -> Column:
        key, value = F.lag("key", at).over(w), F.lag("value", at).over(w)
        step = (F.col("value") - value) == (1 if at > 0 else -1)
        return F.coalesce((key == F.col("key")) & ((F.col("kind") == "b") | step), F.lit(False))

    seen = marked.withColumns({"back": _any([beside(i) for i in range(1, reach + 1)]), "ahead": _any([beside(-i) for i in range(1, reach + 1)])})
    return seen.filter("back or ahead").select("doc_id", "line_no", "kind", "key", "value", (~F.col("back")).alias("starts"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def chapters(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_no, heading) with chapter, from 0: a new one at each heading of the document's smallest level.

    The first chapter takes what stands before the first such heading, unless that is the document's first block.
    """
    top = blocks.filter("heading > 0").groupBy("doc_id").agg(F.min("heading").alias("top"))
    w = _order(by="block_no")
    starts = F.when((F.col("heading") == F.col("top")) & (F.row_number().over(w) > 1), 1).otherwise(0)
    return blocks.join(top, "doc_id", "left").withColumn("starts", starts).withColumn("chapter", F.sum("starts").over(w)).drop("starts", "top")


def fenced(lines: DataFrame) -> DataFrame:
    """lines with is_fence, and in_code between an opening fence and its closing one."""
    w = _order()
    is_fence = F.col("text").rlike("^```")
    opened = F.sum(is_fence.cast("int")).over(w)
    return lines.withColumn("is_fence", is_fence).withColumn("in_code", ~F.col("is_fence") & (opened % 2 == 1))


def merged_runs(runs: DataFrame, style: str = "style") -> DataFrame:
    """(doc_id, run_no, style, first_pos, n, text): neighbouring runs (doc_id, pos, style, text) of one style as one."""
    w = _order(by="pos")
    new = F.coalesce((~F.col(style).eqNullSafe(F.lag(style).over(w))).cast("int"), F.lit(1))
    numbered = runs.withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("run_no", F.sum("new").over(w))
    rows = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return numbered.groupBy("doc_id", "run_no").agg(F.first(style).alias(style), F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"))


def tab_ranges(starts: DataFrame, last: DataFrame) -> DataFrame:
    """(doc_id, tab_no, first, last): tabs that begin at paragraphs (doc_id, tab_no, first), each up to the next's start."""
    to = F.coalesce(F.lead("first").over(_order(by="first")) - 1, F.col("last"))
    return starts.join(last, "doc_id").select("doc_id", "tab_no", "first", to.alias("last"))


def of_tab(rows: DataFrame, starts: DataFrame, at: str = "line_no") -> DataFrame:
    """rows with the tab_no that the last start at or before them names, null before the first."""
    both = rows.select("doc_id", F.col(at).alias("at"), F.lit(1).alias("is_row"), F.lit(None).cast("long").alias("tab_no")).unionByName(starts.select("doc_id", F.col("first").alias("at"), F.lit(0).alias("is_row"), F.col("tab_no").cast("long").alias("tab_no")))
    w = Window.partitionBy("doc_id").orderBy("at", "is_row")
    return both.withColumn("tab_no", F.last("tab_no", ignorenulls=True).over(w)).filter("is_row = 1").select("doc_id", F.col("at").alias(at), "tab_no")


def offsets(lines: DataFrame) -> DataFrame:
    """lines with start: the characters before each in its document, one for each line end."""
    w = _order().rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))


def page_numbers(figures: DataFrame, wanted: Column) -> DataFrame:
    """figures (doc_id, page, y0, x0) with number: each figure's place on its page; only then are the wanted ones kept."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0")
    return figures.withColumn("number", F.row_number().over(w)).filter(wanted)
