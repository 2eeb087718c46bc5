"""Blocks as text, HTML, Markdown and chapters: ordered concatenation of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import escaped


def ordered_text(rows: DataFrame, key: str, order: str, text: str, glue: str) -> DataFrame:
    """(key, text): each key's texts in order, with glue between."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda r: r["t"]), glue).alias("text"))


def block_html(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): blocks (key, block_no, heading, text) as headings and paragraphs of HTML."""
    tag = F.when(F.col("heading") > 0, F.concat(F.lit("h"), F.col("heading"))).otherwise("p")
    return ordered_text(blocks.withColumn("_html", F.concat(F.lit("<"), tag, F.lit(">"), escaped("text", quotes=False), F.lit("</"), tag, F.lit(">"))), key, "block_no", "_html", "\n")


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]#|])", r"\\$1")


def markdown(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): blocks (key, block_no, heading, text) as Markdown."""
    line = F.concat(F.when(F.col("heading") > 0, F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "))).otherwise(""), markdown_escaped(F.col("text")))
    return ordered_text(blocks.withColumn("_md", line), key, "block_no", "_md", "\n\n")


def markdown_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, text): cells (doc_id, row, col, text) as pipe tables; cells that nothing fills are blank."""
    width = cells.groupBy("doc_id").agg((F.max("col") + 1).alias("n"))
    rows = cells.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", markdown_escaped(F.col("text")).alias("t")))).alias("m")).join(width, "doc_id")
    filled = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    line = F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("n")))
    return ordered_text(rows.withColumn("_line", F.when(F.col("row") == 0, F.concat(line, rule)).otherwise(line)), "doc_id", "row", "_line", "\n")


def inferred_headings(paras: DataFrame, ratio: float = 1.3, longest: int = 60, most: int = 3) -> DataFrame:
    """paras (doc_id, block_no, size, text) with heading: the body has the size of most characters; up to three larger
    sizes of short paragraphs are levels 1 to 3, the largest first."""
    sizes = paras.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", F.col("size"))).alias("body"))
    big = paras.join(body, "doc_id").filter((F.col("size") >= F.col("body") * ratio) & (F.length("text") <= longest)).select("doc_id", "size").distinct()
    level = big.withColumn("heading", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).filter(F.col("heading") <= most)
    short = paras.withColumn("_short", F.length("text") <= longest)
    out = short.join(level, ["doc_id", "size"], "left")
    return out.withColumn("heading", F.when(F.col("_short"), F.coalesce("heading", F.lit(0))).otherwise(0)).drop("_short")
