"""Winnowing fingerprints with DataFrame functions alone.

Every run of `k` tokens has a hash. Of each `w` neighbouring hashes the smallest is chosen, of equal ones the rightmost,
and what is chosen is kept once with its position: so two texts that share `k + w - 1` tokens in a row share a
fingerprint entry from there, whatever surrounds them. Tokens are runs of up to 24 code points without (ASCII) white
space; in scripts that write no spaces between words, single code points. A text of fewer than `k` tokens has one run, all of it,
and a text of fewer than `w` runs one window. A null text is empty; a text without tokens has the one entry of the empty
run.

An entry is one long: 40 bits of the run's hash above 24 bits of its position, written so that the smaller of two equal
hashes stands further right. Positions count tokens, and start anew after every 16,777,216 of them. A run's hash is made of
its tokens' hashes, as a rolling hash is, but with `k` small it is taken from them anew: built-in functions carry no state
from one element to the next without copying it. Long texts are worked on in segments of windows, so what one step makes doesn't grow.
Likeness is the Jaccard similarity of two fingerprints' hashes, positions left aside.

Order: rows go by descending doc_id, null ids last; rows with the same id by descending text; the row after the last is
the first. Each row's next is found within blocks of neighbouring rows, each of which also gets the last row of the block
that follows it, so that no task holds all rows; rows with the same id and text stay in one block, which streams them. Other columns of docs, whatever their names, are left aside; no rows give
no rows, and a single row follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import texts, written

SEGMENT = 4096
MOST_BLOCKS = 1 << 14
_LOW = (1 << 24) - 1
#: Fixed value: scripts whose code points are tokens of their own.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[^\s{_UNSPACED}]{{1,24}}|[{_UNSPACED}]"


def fingerprint(text: str, k: int = 4, w: int = 4) -> Column:
    """array<long>: the entries of the string column, in order of their windows."""
    pattern = TOKEN.replace("\\", "\\\\")
    runs, windows = f"greatest(size(t) - {k - 1}, 1)", f"greatest(size(t) - {k + w - 2}, 1)"
    run = ", ".join(f"get(t, s + i + {n})" if n else "get(t, s + i)" for n in range(k))
    entry = f"(xxhash64({run}) & {~_LOW}L) | (({_LOW} - (s + i)) & {_LOW})"
    entries = f"transform(sequence(0, least({SEGMENT + w - 1}, {runs} - s) - 1), i -> {entry})"
    chosen = f"transform(sequence(1, least({SEGMENT}, {windows} - s)), j -> array_min(slice(h, j, {w})))"
    # a lambda's variable is worked out once; array(x) with one element makes one of anything
    segment = f"get(transform(array({entries}), h -> array_distinct({chosen})), 0)"
    tokens = f"transform(regexp_extract_all({text}, '{pattern}', 0), x -> xxhash64(x))"
    return F.expr(f"get(transform(array({tokens}), t -> array_distinct(flatten(transform(sequence(0, {windows} - 1, {SEGMENT}), s -> {segment})))), 0)")


def hashes(entries: str) -> Column:
    """The distinct hashes of entries, without positions."""
    return F.expr(f"array_distinct(transform({entries}, x -> shiftright(x, 24)))")


def likeness(a: str, b: str) -> Column:
    """Of two columns of distinct hashes: shared ones over all."""
    return F.expr(f"size(array_intersect({a}, {b})) / size(array_union({a}, {b}))")


def as_text(entries: str) -> Column:
    """Entries in hexadecimal, parted by spaces: the hash's digits, then six of the position."""
    return F.expr(f"array_join(transform({entries}, x -> hex(x ^ {_LOW}L)), ' ')")


def _block(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are below the key, by halving."""
    steps = len(bounds).bit_length()
    if not bounds:
        return F.lit(0).cast("long")
    held = F.split(F.lit(",".join(map(str, [*bounds, *[(1 << 63) - 1] * ((1 << steps) - 1 - len(bounds))]))), ",").cast("array<long>")  # one literal
    further = lambda at, step: at + F.when(F.get(held, at + step - 1) < key, step).otherwise(0)
    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(steps)))), F.lit(0), further).cast("long")


def _bounds(rows: DataFrame, key: Column, blocks: int) -> list[int]:
    """Values of key that part rows into that many blocks of like size, nearly; equal ones where a value fills several."""
    if blocks < 2:
        return []
    return rows.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], max(10_000, 10 * blocks)).alias("b")).first().b or []


def with_next(rows: DataFrame, marks: Column, block_rows: int = 2_048) -> DataFrame:
    """doc_id, text, marks of each row, and next_text, next_marks of the row that follows by descending doc_id.

    Blocks are ranges of ids with some `block_rows` rows, MOST_BLOCKS at most, parted by the ids' quantiles, so ids may lie as they like. Rows
    without an id, and ids with more rows than a block, are parted by their texts' first bytes as well.
    """
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    blocks = min(max(n // block_rows, 1), MOST_BLOCKS)
    bounds = _bounds(rows, F.col("doc_id"), blocks)
    often = sorted({a for a, b in zip(bounds, bounds[1:]) if a == b})
    bounds = sorted({*bounds, *(a - 1 for a in often if a > -(1 << 63))})  # an id that fills blocks has one of its own
    many = F.lit(False) if not often else F.coalesce(F.array_contains(F.lit(often).cast("array<long>"), F.col("doc_id")), F.lit(False))
    many = many | F.col("doc_id").isNull() if nulls > block_rows else many
    first = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    inner = _bounds(rows.filter(many), first, blocks) if often or nulls > block_rows else []
    place = F.when(F.col("doc_id").isNull(), F.lit(0).cast("long")).otherwise(1 + _block(bounds, F.col("doc_id")))
    rows = rows.withColumn("block", place * (len(inner) + 1) + (F.when(many, _block(inner, first)).otherwise(F.lit(0).cast("long")) if inner else 0))

    circle = Window.orderBy("block")  # of a bounded number of blocks
    tops = rows.groupBy("block").agg(F.max("doc_id").alias("top"))
    after = tops.select(F.col("block").alias("of"), "top", F.coalesce(F.lead("block").over(circle), F.min("block").over(circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    # a few rows for many documents: written, so that Spark knows their size and can choose the join by it
    after = written(after, "block-ends")
    last = rows.join(after, (F.col("block") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    last = last.groupBy("after").agg(F.max("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("after").alias("block"), F.lit(True).alias("lent"))
    both = rows.withColumn("lent", F.lit(False)).unionByName(last).repartition("block").withColumn("marks", marks)
    order = Window.partitionBy("block").orderBy(F.desc("lent"), F.asc_nulls_first("doc_id"), "text")
    return both.withColumn("next_text", F.lag("text").over(order)).withColumn("next_marks", F.lag("marks").over(order)).filter(~F.col("lent")).drop("block", "lent")


def compare_edits(docs: DataFrame, k: int = 4, w: int = 4, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 2_048) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The edited text has its last floor(n_chars / 3) code points replaced by as many of the next row's first ones, or all.
    """
    rows = with_next(texts(docs, id_col, text_col), fingerprint("text", k, w), block_rows)
    rows = rows.withColumn("edited", F.expr("concat(left(text, length(text) - length(text) div 3), left(next_text, length(text) div 3))"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "marks", fingerprint("edited", k, w).alias("edited_marks"), hashes("next_marks").alias("next"))
    rows = rows.withColumns({"own": hashes("marks"), "changed": hashes("edited_marks")})
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text("marks").alias("fingerprint"), as_text("edited_marks").alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"), likeness("own", "next").alias("near_next"))
