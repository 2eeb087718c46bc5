"""Plain text, Markdown, CSV and bytes of unknown encoding, as columns and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import escaped
from quire.operators.flow import fenced

#: What a file's extension is read as.
KINDS = {"docx": "parts", "odt": "zip", "epub": "zip", "xlsx": "zip", "pptx": "zip", "hwpx": "zip", "rtf": "rtf", "md": "markdown", "markdown": "markdown", "txt": "text", "csv": "csv", "tsv": "csv", "html": "html", "htm": "html", "xhtml": "html", "pdf": "pdf", "hwp": "hwp"}
OLD = ("doc", "xls", "ppt")


def kind_of(name: Column) -> Column:
    """What a file is read as, by its extension; "old format" for those that are refused, null for unknown ones."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(ext.isin(*OLD), F.lit("old format"))
    for e, kind in KINDS.items():
        out = out.when(ext == e, F.lit(kind))
    return out


def decoded(data: Column) -> Column:
    """Bytes as text: by a byte order mark, else as UTF-8 where that is valid, else as Korean (cp949)."""
    head = lambda n: F.hex(F.substring(data, 1, n))

    @F.pandas_udf("string")
    def korean(x):
        return x.map(lambda b: None if b is None else bytes(b).decode("cp949", "replace"))

    body = lambda n: F.substring(data, n + 1, 2147483647)
    return (
        F.when(head(3) == "EFBBBF", F.decode(body(3), "UTF-8"))
        .when(head(2) == "FFFE", F.decode(body(2), "UTF-16LE"))
        .when(head(2) == "FEFF", F.decode(body(2), "UTF-16BE"))
        .when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
        .otherwise(korean(data))
    )


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, html): one paragraph for each line of a text, whatever ends its lines."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    return docs.select("doc_id", F.posexplode(lines).alias("block_no", "line")).select("doc_id", "block_no", F.concat(F.lit("<p>"), escaped("line", quotes=False), F.lit("</p>")).alias("html"))


def markdown_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, level, body): lines of Markdown as code, heading, rule, item, number, quote, row, blank or text.

    Lines between fences are code, fences themselves are left out.
    """
    t = F.col("text")
    kind = (
        F.when(F.col("in_code"), "code").when(t.rlike(r"^#{1,6}\s+\S"), "heading").when(t.rlike(r"^\s*([-*_])(\s*\1){2,}\s*$"), "rule")
        .when(t.rlike(r"^\s*[-*+]\s+\S"), "item").when(t.rlike(r"^\s*[0-9]+[.)]\s+\S"), "number").when(t.rlike(r"^\s*>"), "quote")
        .when(t.rlike(r"^\s*\|.*\|\s*$"), "row").when(t.rlike(r"^\s*$"), "blank").otherwise("text")
    )
    bare = F.when(F.col("in_code"), t).otherwise(F.trim(F.regexp_replace(t, r"^\s*(#{1,6}\s+|[-*+]\s+|[0-9]+[.)]\s+|>\s?)", "")))
    rows = fenced(lines).filter(~F.col("is_fence"))
    level = F.when(kind == "heading", F.length(F.regexp_extract(t, "^(#{1,6})", 1))).otherwise(0)
    return rows.select("doc_id", "line_no", kind.alias("kind"), level.alias("level"), bare.alias("body"))


def inline_html(text: Column) -> Column:
    """Bold, italic, struck and code marks of a Markdown line as HTML; its own < > & are escaped first."""
    out = escaped(text, quotes=False)
    for pattern, tag in ((r"\*\*([^*]+)\*\*", "b"), (r"~~([^~]+)~~", "s"), (r"`([^`]+)`", "code"), (r"\*([^*]+)\*", "i")):
        out = F.regexp_replace(out, pattern, f"<{tag}>$1</{tag}>")
    return out


def separator(first_line: Column) -> Column:
    """Semicolon if a CSV's first line has more of these than commas, else comma."""
    count = lambda c: F.length(first_line) - F.length(F.replace(first_line, F.lit(c)))
    return F.when(count(";") > count(","), ";").otherwise(",")


#: A quoted stretch of a CSV; one that nothing closes ends with the text. All loops are possessive, so no length is too much.
_QUOTED = r'"(?:[^"]++|"")*+(?:"|\z)'


def csv_cells(docs: DataFrame, sep: str | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, row, col, value): the cells of CSV texts, quoted as usual; sep: None for comma or semicolon, as the first line says.

    A row ends at a line end outside quotes; carriage returns outside quotes are left out. Quotes inside a cell that doesn't
    begin with one quote what follows too. Null and empty texts have no rows; most: rows of each text to keep, None for all.
    """
    bare = F.regexp_replace("text", rf"({_QUOTED})|\r", "$1")
    lines = docs.select("doc_id", bare.alias("text"), (F.lit(sep) if sep else separator(F.substring_index("text", "\n", 1))).alias("sep"))
    found = F.regexp_extract_all(F.concat(F.lit("\n"), "text"), F.lit(rf'\n((?:{_QUOTED}|[^"\n]++)*+)'), 1)
    whole = F.when(F.element_at(found, -1).isin("", '""'), F.slice(found, 1, F.size(found) - 1)).otherwise(found)
    rows = lines.select("doc_id", "sep", F.posexplode(whole).alias("row", "line"))
    rows = rows if most is None else rows.filter(F.col("row") < most)
    of = lambda s: F.regexp_extract_all(F.concat(F.lit(s), "line"), F.lit(rf'{s}((?:{_QUOTED}|[^"{s}]++)*+)'), 1)
    split = of(sep) if sep else F.when(F.col("sep") == ";", of(";")).otherwise(of(","))
    cells = rows.select("doc_id", "row", F.posexplode(split).alias("col", "raw"))
    value = F.replace(F.regexp_replace("raw", r'"((?:[^"]++|"")*+)(?:"|\z)', "$1"), F.lit('""'), F.lit('"'))
    return cells.select("doc_id", "row", "col", value.alias("value"))
