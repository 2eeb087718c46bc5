"""Zip-based office files: members as rows, and the rows and paragraphs in their XML.

Files come as rows of (doc_id, content), as spark.read.format("binaryFile") gives them; every file is opened in the task
that holds it. Images, styles and layout are left aside.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMBERS = "doc_id long, name string, data binary"
#: Fixed value: the kind of relationship by which a package names its main part.
MAIN_PART = "/relationships/officeDocument"


def _opened(data: bytes | None) -> Iterator[tuple[str, bytes]]:
    """(name, content) of a zip file's readable members, in order; damaged or encrypted ones are left out, null has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    try:
                        yield i.filename, z.read(i)
                    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError):
                        pass
    except (zipfile.BadZipFile, TypeError, ValueError, EOFError, OSError):
        pass


def _tree(data: bytes) -> list[ElementTree.Element]:
    """All elements of an XML part, in document order; none of one that is no XML."""
    try:
        return [*ElementTree.fromstring(bytes(data)).iter()]
    except (ElementTree.ParseError, ValueError, LookupError):
        return []


def members(files: DataFrame, pattern: str = ".*") -> DataFrame:
    """(doc_id, name, data): the members of zip files whose names match; broken files have none."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch["doc_id"], batch["content"]):
                yield pd.DataFrame([(doc, n, x) for n, x in _opened(data) if re.fullmatch(pattern, n)], columns=["doc_id", "name", "data"])

    return files.select("doc_id", "content").mapInPandas(opened, MEMBERS)


def main_parts(files: DataFrame) -> DataFrame:
    """(doc_id, name, data): the part that each package's own relationships name as its document."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch["doc_id"], batch["content"]):
                parts = dict(_opened(data))
                named = {e.attrib.get("Target", "").lstrip("/") for e in _tree(parts.get("_rels/.rels", b"")) if e.attrib.get("Type", "").endswith(MAIN_PART)}
                yield pd.DataFrame([(doc, n, parts[n]) for n in sorted(named) if n in parts], columns=["doc_id", "name", "data"])

    return files.select("doc_id", "content").mapInPandas(opened, MEMBERS)


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ElementTree.Element) -> str:
    """The text of the t, tab, br and line-break elements and of text nodes below e."""
    out = []
    for x in e.iter():
        n = _name(x)
        if n in ("t", "span", "p", "h", "a"):
            out.append(x.text or "")
        elif n in ("tab", "br", "line-break", "s"):
            out.append("\t" if n == "tab" else " " if n == "s" else "\n")
        if x is not e and n not in ("t",):
            out.append(x.tail or "")
    return "".join(out)


def _blocks(parts: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(doc_id, name, block_no, kind, level, text) of the elements named in wanted, in each XML part's order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, name, data in batch.itertuples(index=False):
                rows = []
                for e in _tree(data):
                    kind = wanted.get(_name(e))
                    if kind:
                        style = next((v for x in e.iter() if _name(x) == "pStyle" for v in x.attrib.values()), "")
                        level = next((int(v) for k, v in e.attrib.items() if k.endswith("outline-level") and v.isdigit()), 0) or int((re.search(r"(?i)heading\s*([1-6])", style) or [0, 0])[1])
                        rows.append((doc, name, len(rows), "heading" if level else kind, level, _text(e)))
                yield pd.DataFrame(rows, columns=["doc_id", "name", "block_no", "kind", "level", "text"])

    return parts.mapInPandas(read, "doc_id long, name string, block_no int, kind string, level int, text string")


def docx_blocks(files: DataFrame) -> DataFrame:
    return _blocks(main_parts(files), {"p": "paragraph"})


def odt_blocks(files: DataFrame) -> DataFrame:
    return _blocks(members(files, r"content\.xml"), {"p": "paragraph", "h": "heading"})


def pptx_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs of slides with slide, in the order of the slides' numbers."""
    slides = _blocks(members(files, r"ppt/slides/slide[0-9]+\.xml"), {"p": "paragraph"}).filter("text <> ''")
    return slides.withColumn("slide", F.regexp_extract("name", "slide([0-9]+)", 1).cast("int"))


def xlsx_cells(files: DataFrame, most_rows: int | None = None, most_cols: int | None = None) -> DataFrame:
    """(doc_id, sheet, row, col, value): cells as text, shared strings looked up; blank rows dropped, all others kept unless
    most_rows and most_cols say how many."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, name, data in batch.itertuples(index=False):
                rows = []
                shared = name.endswith("sharedStrings.xml")
                for i, e in enumerate(x for x in _tree(data) if _name(x) == ("si" if shared else "c")):
                    if shared:
                        rows.append((doc, name, i, 0, "".join(t.text or "" for t in e.iter() if _name(t) == "t"), "shared"))
                        continue
                    at = re.match(r"([A-Z]+)([0-9]+)", e.attrib.get("r", ""))
                    col = 0
                    for letter in at[1] if at else "":
                        col = col * 26 + ord(letter) - 64
                    value = "".join(x.text or "" for x in e.iter() if _name(x) in ("v", "t"))
                    rows.append((doc, name, int(at[2]) - 1 if at else i, col - 1, value, e.attrib.get("t", "n")))
                yield pd.DataFrame(rows, columns=["doc_id", "name", "row", "col", "value", "type"])

    parts = members(files, r"xl/(worksheets/sheet[0-9]+|sharedStrings)\.xml")
    cells = parts.mapInPandas(read, "doc_id long, name string, row int, col int, value string, type string")
    shared = cells.filter("type = 'shared'").select("doc_id", F.col("row").cast("string").alias("value"), F.col("value").alias("text"), F.lit("s").alias("type"))
    own = cells.filter("type <> 'shared'").join(shared, ["doc_id", "value", "type"], "left").withColumn("value", F.coalesce("text", "value")).filter(F.trim("value") != "")
    place = F.dense_rank().over(Window.partitionBy("doc_id", "sheet").orderBy("row")) - 1
    numbered = own.withColumn("sheet", F.regexp_extract("name", "sheet([0-9]+)", 1).cast("int")).withColumn("row", place)
    for column, most in (("row", most_rows), ("col", most_cols)):
        numbered = numbered if most is None else numbered.filter(F.col(column) < most)
    return numbered.select("doc_id", "sheet", "row", "col", "value")


def epub_chapters(files: DataFrame) -> DataFrame:
    """(doc_id, chapter, name, html): the chapters of an EPUB in the order of its spine."""

    def spine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, name, data in batch.itertuples(index=False):
                items, order, folder = {}, [], name.rpartition("/")[0]
                for e in _tree(data):
                    if _name(e) == "item":
                        items[e.attrib.get("id")] = unquote(e.attrib.get("href", "").partition("#")[0])
                    elif _name(e) == "itemref":
                        order.append(e.attrib.get("idref"))
                names = [posixpath.normpath(f"{folder}/{items[i]}").lstrip("/") for i in order if items.get(i)]
                yield pd.DataFrame([(doc, i, n) for i, n in enumerate(names)], columns=["doc_id", "chapter", "name"])

    order = members(files, r".*\.opf").mapInPandas(spine, "doc_id long, chapter int, name string")
    return order.join(members(files, r".*\.x?html?"), ["doc_id", "name"]).select("doc_id", "chapter", "name", F.decode("data", "UTF-8").alias("html"))


#: Destinations of RTF that hold no text of the document, and control words that stand for characters.
RTF_ASIDE = frozenset(
    "fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr listtable listoverridetable rsidtbl generator xmlnstbl themedata colorschememapping datastore latentstyles fldinst".split()
)
RTF_CONTROLS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "cell": "\t", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?[0-9]+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", re.S)


def _rtf(text: str | None) -> str | None:
    """The text of one RTF file, token by token; groups may nest as deep as they like."""
    if text is None:
        return None
    page = re.search(r"\\ansicpg([0-9]+)", text)
    coding = {"949": "cp949", "65001": "utf-8"}.get(page[1], f"cp{page[1]}") if page else "cp1252"
    out, held, groups, aside, width, skip = [], bytearray(), [], False, 1, 0

    def flush() -> None:
        if held:
            try:
                out.append(held.decode(coding, "replace"))
            except LookupError:
                out.append(held.decode("cp1252", "replace"))
            held.clear()

    for m in _RTF.finditer(text):
        byte, control, number, sign, brace, plain = m.groups()
        if byte:
            if skip:
                skip -= 1
            elif not aside:
                held.append(int(byte, 16))
            continue
        flush()
        if brace == "{":
            groups.append((aside, width))
        elif brace:
            aside, width = groups.pop() if groups else (aside, width)
        elif sign:
            if sign == "*":
                aside = True
            elif sign in "\\{}~" and not aside:
                out.append("\u00a0" if sign == "~" else sign)
        elif control:
            aside = aside or control in RTF_ASIDE
            if control == "uc":
                width = int(number or 1)
            elif control == "u" and number and not aside:
                out.append(chr(int(number) % 65536))
                skip = width
            elif not aside:
                out.append(RTF_CONTROLS.get(control, ""))
        elif plain:
            out.append("" if aside else plain[skip:])
            skip = max(0, skip - len(plain))
    flush()
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").removesuffix("\n")


def rtf_text(files: DataFrame) -> DataFrame:
    """(doc_id, text): the text of RTF files (doc_id, content as string): destinations such as tables of fonts and pictures
    are left out, \\par and the like end lines, \\uN and \\'hh are characters, the latter in the file's own code page."""

    @F.pandas_udf("string")
    def read(x: pd.Series) -> pd.Series:
        return x.map(_rtf)

    return files.select("doc_id", read(F.col("content").cast("string")).alias("text"))
