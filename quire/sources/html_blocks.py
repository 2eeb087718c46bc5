"""Web pages as blocks of text with their element, by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text, and elements that end a block.
DROPPED = frozenset("script style noscript template iframe object embed head".split())
VOID = frozenset(["embed"])
BLOCKS = frozenset("p div section article nav aside header footer h1 h2 h3 h4 h5 h6 li ul ol table tr blockquote pre figure body html".split())


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, str]] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.dropped: list[str] = []

    def end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            tag = next((t for t in reversed(self.open) if t in BLOCKS), "body")
            self.rows.append((tag, sum(t in ("ul", "ol") for t in self.open), text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS and self.dropped == ["head"]:
            self.dropped = []  # a head's end may be left out
        if tag in DROPPED and tag not in VOID:
            self.dropped.append(tag)
        if tag in BLOCKS:
            self.end_block()
            if tag in ("p", "li") and tag in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag)]
            self.open.append(tag)
        elif tag in ("br", "td", "th"):
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.dropped:
            del self.dropped[len(self.dropped) - 1 - self.dropped[::-1].index(tag) :]
        if tag in BLOCKS and tag in self.open:
            self.end_block()
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, tag, depth, text): blocks of text in page order, the element around each, and its list depth."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"]):
                parser = _Blocks()
                parser.feed(html)
                parser.close()
                parser.end_block()
                rows += [(page, i, *r) for i, r in enumerate(parser.rows)]
            yield pd.DataFrame(rows, columns=["page_id", "block_no", "tag", "depth", "text"])

    return pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(read, "page_id long, block_no int, tag string, depth int, text string")


def plain_text(html: str = "html"):
    """HTML as text by patterns alone: scripts, styles and comments dropped (to the end where they
    aren't closed), block ends as line ends, cells as tabs."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b(?:(?!</\1>).)*+(?:</\1>|\z)|<!--(?:(?!-->).)*+(?:-->|\z)", "")
    t = F.regexp_replace(t, r"[ \t\r\n]+", " ")
    t = F.regexp_replace(t, r"(?i)</t[dh]>\s*(?=<t[dh])", "\t")
    t = F.regexp_replace(t, r"(?i)</(p|div|li|tr|h[1-6]|article|nav|footer|ul|ol|table)>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^<>]*+>", "")
    t = F.regexp_replace(t, r"(?<! ) *+\n *+", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|(?<!\s)\s++\z", "")
