"""How lines go on in the next ones, from their places, sizes and weights, and from the words that the document knows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import PARTICLES, is_label_line, is_list_line, is_toc_line, let, same_list_next, sigmoid, stem, word_core
from quire.operators.flow import END

CLOSING = r"^[.,!?;:)\]}」』》〉”’…]"


def _known_forms(text: Column) -> Column:
    """The words inside a line, alone and without a particle, each once; the first and last word, which may be cut, don't count."""
    parts = F.split(text, " ")
    words = F.array_distinct(F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), word_core), lambda t: t != ""))
    bare = lambda t: [F.when(t.endswith(p) & (F.length(t) > len(p)), F.left(t, F.length(t) - len(p))) for p in PARTICLES]
    # particles are Hangul, so most words need no look at each of them
    forms = lambda t: F.when(t.rlike(r"[가-힣]\z"), F.array_compact(F.array(t, *bare(t)))).otherwise(F.array(t))
    return F.array_distinct(F.flatten(F.transform(words, forms)))


def _first_of(cases: list[tuple[Column, str]]) -> Column:
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), F.lit(None).cast("string"))


def beside(lines: DataFrame) -> DataFrame:
    """Each line with what its neighbours say: the columns of the line before it (p_), of the one before that (q_) and of the
    next one (n_), and whether they stand in one group on one page."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    near = {f"p_{c}": F.lag(c).over(w) for c in ("text", "x0", "x1", "oy", "size", "weight", "angle", "page", "grp", "left", "right", "justified")}
    near |= {f"q_{c}": F.lag(c, 2).over(w) for c in ("oy", "size", "grp", "page")} | {f"n_{c}": F.lead(c).over(w) for c in ("x0", "oy", "size", "grp", "page", "left")}
    return lines.withColumns(near).withColumns({"same_page": F.col("page") == F.col("p_page"), "same": (F.col("page") == F.col("p_page")) & (F.col("grp") == F.col("p_grp"))})


def pairs(lines: DataFrame) -> DataFrame:
    """Each line after its document's first with what its neighbours say (`beside`)."""
    return beside(lines).filter("p_text is not null")


def breaks(paired: DataFrame) -> DataFrame:
    """paired with step (to the line before), expected (the step to expect), break (why a paragraph begins whatever the widths
    say, else null) and missing (whether characters may be missing between both lines)."""
    c = F.col
    alike = lambda a, b: F.abs(c(a) - c(b)) < 0.5
    around = F.least(
        F.when((c("q_page") == c("p_page")) & (c("q_grp") == c("p_grp")) & alike("q_size", "p_size") & (c("p_oy") > c("q_oy")), c("p_oy") - c("q_oy")),
        F.when((c("n_page") == c("page")) & (c("n_grp") == c("grp")) & alike("n_size", "size") & (c("n_oy") > c("oy")), c("n_oy") - c("oy")),
    )
    base = F.when(alike("p_size", "size") & (F.abs(c("size") - c("body")) > c("body") * 0.12), c("pitch") * c("size") / c("body")).otherwise(c("pitch"))
    larger = F.greatest("size", "p_size")
    ended, indent = c("p_text").rlike(END), c("x0") - c("left")
    beside = F.when((c("n_page") == c("page")) & (c("n_grp") == c("grp")), c("n_x0") - c("n_left")).otherwise(0.0)
    aligned = c("same") & (F.abs(c("x0") - c("p_x0")) < c("size") * 0.35) & (c("p_x0") - c("p_left") > c("size") * 0.3)
    mark = lambda t: F.substring_index(t, " ", 1)
    sign = mark("text").rlike(r"^[^\p{L}\p{N}\s]\z") & (mark("p_text") == mark("text")) & c("text").contains(" ")
    item = is_list_line("text")
    turned = lambda a: F.abs(a) >= 0.3
    rows = paired.withColumns({"step": c("oy") - c("p_oy"), "expected": F.coalesce(F.greatest(base, around), base), "ended": ended, "item": item})
    missing = c("same") & (c("step") > 0) & (c("step") <= c("pitch") * 1.15) & ~ended & ~item & (c("x0") - F.when(c("p_x0") - c("p_left") > c("p_size") * 0.3, c("p_x0")).otherwise(c("p_left")) > c("size") * 2.5)
    missing &= ~((larger > c("body") * 1.5) & (F.least("size", "p_size") >= c("body") * 0.8) & (larger > F.least("size", "p_size") * 1.3))
    reason = _first_of([
        (is_toc_line("p_text"), "end of a contents entry"), (turned(c("angle")) | turned(c("p_angle")), "turned text"),
        (~c("same") & c("same_page") & (c("step") > larger * 2.2), "gap between sections"), (F.abs(c("size") - c("p_size")) > larger * 0.12, "size"),
        ((F.abs(c("weight") - c("p_weight")) >= 250) & (ended | (c("p_right") - c("p_x1") > c("p_size"))), "weight"),
        (c("same") & (c("step") > c("expected") + F.greatest(c("size") * 0.3, c("pitch") * 0.15)), "gap"), (c("same") & (c("step") < 0), "going back"),
        ((indent > c("size") * 0.6) & ~aligned & ~((beside > c("size") * 0.6) & (F.abs(beside - indent) < c("size") * 0.3)), "indent"),
        (is_label_line("p_text") & is_label_line("text"), "labels"), (c("same") & sign, "same sign"),
        (item & c("text").contains(" ") & (ended | c("p_text").endswith(":") | (c("p_right") - c("p_x1") > c("size") * 2) | same_list_next(mark("p_text"), mark("text"))), "list mark"),
    ])
    return rows.withColumn("missing", missing).withColumn("break", F.when(~missing, reason))


def line_joins(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, conf, reason): how each line after its document's first goes on from the one before it: para, or
    one text with a space, with none, or with the hyphen at the line's end dropped.

    lines: doc_id, line_no, page, grp (a column of a page), text, x0, x1, oy, size, weight, angle, and of their column left,
    right, pitch, justified, body and space. What breaks lines comes first (`breaks`); then a line that ends early though
    the next word had room ends a paragraph; hyphens go where the document knows the word without them; the rest is a sum
    of evidence for a space, turned into a confidence, and words that the document has in one piece are joined.
    """
    c = F.col
    rows = breaks(beside(lines))
    head, tail = F.substring_index("text", " ", 1), F.substring_index("p_text", " ", -1)
    rows = rows.withColumns({"a": word_core(tail), "b": word_core(head), "char": (c("x1") - c("x0")) / F.greatest(F.length("text"), F.lit(1)), "n_head": F.length(head)})
    hyphen = c("p_text").rlike(r"\p{L}[-‐]\z") & c("p_text").rlike(r"[A-Za-zÀ-ɏ][-‐]\z") & c("text").rlike("^[A-Za-zÀ-ɏ]")
    bare = F.regexp_replace("a", "[-‐]\\z", "")
    rows = rows.withColumns({"hyphen": hyphen, "joined": stem(F.concat(F.when(hyphen, bare).otherwise(c("a")), "b")), "hyphened": F.concat(bare, F.lit("-"), "b")})
    slack = c("p_right") - c("p_x1")
    same_size = F.abs(c("size") - c("p_size")) <= F.greatest("size", "p_size") * 0.12
    title = c("same") & (c("p_size") > c("body") * 1.15) & same_size & ~c("ended")
    room = ~c("p_justified") & ~title & (slack >= c("n_head") * c("char") + c("space") + c("p_size") * 0.1)
    short = c("p_justified") & ~title & (slack >= c("p_size") * 0.2) & ((slack >= c("char")) | c("ended"))
    bold = c("weight") - c("p_weight") >= 100
    han = c("p_text").rlike(r"[一-鿿぀-ヿ㐀-䶿]\z") & c("text").rlike("^[一-鿿぀-ヿ㐀-䶿]")
    score = F.lit(3.0) - F.when(han, 6.0).otherwise(0.0) + F.when(c("text").rlike(CLOSING), -6.0).when(c("p_text").rlike(r"[.!?…。！？]\z") & c("text").rlike(r"^\p{L}"), 3.0).otherwise(0.0)
    late = c("same") & c("p_text").rlike(r"""[.!?][”’"']?\z""") & (~c("p_justified") | (slack < c("p_size") * 0.2))

    def result(kind: str, conf, reason) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("conf"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    plain = (
        F.when(c("missing"), result("space", 0.3, "characters may be missing")).when(c("break").isNotNull(), result("para", 0.97, c("break")))
        .when(short, result("para", F.when(c("ended") | bold, 0.95).otherwise(0.78), "short line of a justified column")).when(room, result("para", F.when(c("ended") | (slack > c("p_size") * 3), 0.93).otherwise(0.72), "the next word had room"))
    )
    rows = rows.withColumns({"plain": plain, "score": score, "off": ~c("same") & c("ended"), "late": late})
    # Words meet as rows without texts: those that the document knows (slot -1), and what a line asks for where nothing else decides;
    # its own row (slot 0) has the rest. All stay where their document is, so windows and sums need no shuffle.
    ask = lambda slot, key: F.struct(F.lit(slot).alias("slot"), F.col(key).alias("key") if isinstance(key, str) else key.alias("key"))
    none = F.array().cast("array<struct<slot:int,key:string>>")
    whole = F.when((F.length("joined") >= 2) & (c("a") != "") & (c("b") != ""), F.array(ask(1, "joined"))).otherwise(none)
    both = F.when((F.length("a") > 1) & (F.length("b") > 1), F.array(ask(3, stem("a")), ask(4, stem("b")))).otherwise(none)
    asked = F.when(c("plain").isNotNull(), none).when(c("hyphen"), F.array(ask(1, "joined"), ask(2, "hyphened"))).otherwise(F.concat(whole, both))
    own = F.when(c("p_text").isNull(), none).otherwise(F.concat(F.array(ask(0, F.lit(None).cast("string"))), asked))
    knows = F.transform(_known_forms(c("text")), lambda t: ask(-1, t))
    rest = {"kind": c("plain.kind"), "conf": c("plain.conf"), "reason": c("plain.reason")} | {k: c(k) for k in ("hyphen", "score", "off", "late")}
    met = rows.select("doc_id", "line_no", *(v.alias(k) for k, v in rest.items()), F.explode(F.concat(F.coalesce(knows, none), own)).alias("m"))
    met = met.select("doc_id", "line_no", "m.slot", "m.key", *(F.when(c("m.slot") == 0, c(k)).alias(k) for k in rest))
    met = met.withColumn("known", F.bool_or(c("slot") < 0).over(Window.partitionBy("doc_id", "key"))).filter("slot = 0 or (slot > 0 and known)")
    found = met.groupBy("doc_id", "line_no").agg(*(F.max(k).alias(k) for k in rest), *(F.bool_or(c("slot") == i).alias(n) for i, n in enumerate(("joined", "hyphened", "stem_a", "stem_b"), 1)))
    total = c("score") + F.when(c("stem_a") & c("stem_b"), 1.5).otherwise(0.0)
    doubt = F.when(c("off"), 0.6).when(c("late") & (total > 0), 0.7).otherwise(1.0)
    evidence = let(F.struct(total.alias("s"), doubt.alias("d")), lambda e: F.struct(F.when(e["s"] > 0, "space").otherwise("none").alias("kind"), F.round(F.least(sigmoid(F.abs(e["s"])), e["d"]), 3).alias("conf"), F.lit("evidence").alias("reason")))
    out = (
        F.when(c("reason").isNotNull(), F.struct("kind", "conf", "reason")).when(c("hyphen") & c("joined"), result("hyphen-drop", 0.92, "known without its hyphen")).when(c("hyphen") & c("hyphened"), result("none", 0.92, "known with its hyphen"))
        .when(c("hyphen"), result("hyphen-drop", 0.6, "hyphen")).when(c("joined"), result("none", 0.97, "known in one piece")).otherwise(evidence)
    )
    return found.withColumn("o", out).select("doc_id", "line_no", "o.kind", "o.conf", "o.reason")


#: Particles that begin no line by themselves, and endings that begin no word of their own.
STRONG = ("을", "를", "는", "은", "의", "에", "와", "과", "로", "으로", "에서", "에게", "까지", "부터", "처럼", "께서")
ENDINGS = ("니다", "습니다", "었다", "였다", "했다", "이다", "하다", "된다", "한다")


def wrap_modes(lines: DataFrame) -> DataFrame:
    """(doc_id, mode, n, word_only, roomy, mid_word): whether a document's lines break between words or between characters.

    Of seams that nothing else explains: those where a character more had room, but the next word had none (word_only), those
    where a character had room at all (roomy), and those where the next line begins with a particle or an ending.
    """
    c = F.col
    rows = breaks(pairs(lines)).filter("break is null").withColumns({"char": (c("x1") - c("x0")) / F.greatest(F.length("text"), F.lit(1)), "head": F.substring_index("text", " ", 1)})
    rows = rows.filter("char > 0").withColumn("slack", c("p_right") - c("p_x1"))
    tol, core = c("p_size") * 0.1, word_core("head")
    word_only = (c("slack") >= c("char") + c("space") + tol) & (c("slack") < F.length("head") * c("char") + c("space") + tol) & ~c("ended")
    mid = core.isin(*STRONG) | core.rlike("^(?:" + "|".join(ENDINGS) + ")") | c("head").rlike("^[가-힣][.,!?]")
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(word_only).alias("word_only"), F.count_if(c("slack") >= c("char") * 0.95).alias("roomy"), F.count_if(mid).alias("mid_word"))
    by_word = ((c("word_only") >= 2) & (c("word_only") >= c("n") * 0.08)) | (c("roomy") / c("n") > 0.45)
    mode = F.when((c("mid_word") >= 2) & (c("mid_word") >= c("n") * 0.04), "char").when(by_word, "word").otherwise("char")
    return n.select("doc_id", mode.alias("mode"), "n", "word_only", "roomy", "mid_word")


def local_edges(lines: DataFrame, reach: int = 4) -> DataFrame:
    """(doc_id, line_no, local_right): the right edge of the narrow block that a line stands in: of at least three lines in a row
    that are alike (size, left edge, distance), up to `reach` on each side. It counts if 60 % of them end within a character
    of it, it is well inside the column, and the block takes at least 35 % of the column's width.

    A line is like the next by its own size and pitch; a run of alike lines is a block, cut to those around the line.
    """
    c = F.col
    w = Window.partitionBy("doc_id", "page", "grp").orderBy("oy", "line_no")
    p = {f"p_{x}": F.lag(x).over(w) for x in ("size", "x0", "oy", "pitch")}
    like = (F.abs(c("p_size") - c("size")) < c("p_size") * 0.08) & (F.abs(c("p_x0") - c("x0")) < c("p_size") * 2.5) & (F.abs(c("oy") - c("p_oy")) < F.greatest(c("p_pitch"), c("p_size") * 1.2) * 1.6)
    rows = lines.withColumns(p).withColumn("new", F.when(F.coalesce(like, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    near = Window.partitionBy("doc_id", "page", "grp", "run").orderBy("oy", "line_no").rowsBetween(-reach, reach)
    block = rows.withColumns({"n": F.count("*").over(near), "edge": F.max("x1").over(near), "ends": F.collect_list(F.struct("x1", "size")).over(near)})
    full = F.size(F.filter("ends", lambda e: e["x1"] >= c("edge") - e["size"]))
    good = (c("n") >= 3) & (c("edge") <= c("right") - c("size") * 2) & (full >= 2) & (full >= c("n") * 0.6) & (c("edge") - c("left") >= (c("right") - c("left")) * 0.35)
    return block.filter(good).select("doc_id", "line_no", c("edge").alias("local_right"))
