"""Main text of web pages by consensus host paths.

First every page's containers are scored: a block of text gives its length, without what stands in links, to the
container around it, and `FADE` of that to each one further out. The best container's path of generalised tags and
classes is the page's vote, and Spark counts votes per host. Then every page is read again: its text is what stands in
the container at its host's winning path, or, where it has none, in its own best one. Menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are left out wherever they stand.

Blocks end where block-level elements begin or end; <br> and table cells are white space inside a block. White space in
a block becomes one space, blocks are trimmed, and joined by one newline in page order. Nothing else is dropped.

Null html is empty; pages without text get an empty one; null urls share one host. Repeated rows are read one by one.
Markup may be broken: unclosed elements end with their parents, stray end tags are passed over, and an unclosed comment
or script lasts to the page's end; a tag whose quotes never close ends at its first >, and one without any is text. Pages may be of any length and depth:
time and memory grow with the markup alone, however broken. Other
columns of pages, whatever their names, are left aside; no pages give no rows. Of paths with as many votes the first wins.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

FADE = 0.6

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes textarea title xmp noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
CONTAINER = frozenset("html body main article section div td center".split())
LEFT_OUT = frozenset("head nav footer aside form button select option menu menuitem dialog svg canvas object audio video map applet fieldset datalist".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words in a class or id that mark what isn't the article.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted
    cookie cookies consent gdpr notice notices notification notifications alert banner banners popup modal overlay lightbox toast
    newsletter subscribe subscription signup signin login register paywall sidebar sidebars aside rail menu menus nav navbar
    navigation navi breadcrumb breadcrumbs pagination pager paging toolbar topbar masthead footer foot footnav copyright legal
    share sharing social socials related recommended recommendations recirculation trending popular outbrain taboola widget widgets
    comment comments commentlist respond disqus discussion replies search searchbox skiplink offscreen tagcloud""".split()
)
#: Words after which a class or id speaks of something else on the page ("layout-with-sidebar").
TURNS = frozenset("has have with without no not is".split())
GOOD = frozenset("article content post entry story main text body".split())
CLOSED_BY = {t: frozenset([t]) for t in ("li", "tr", "option")} | {"dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th"))}
WALLS = {"li": frozenset(("ul", "ol", "menu")), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "option": frozenset(("select",))}

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?=[\s=/>]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: For each kind of element that ends without an end tag: what ends it, and what that can't reach through.
ENDS = {"p": (frozenset(("p",)), CONTAINER | {"li", "blockquote", "table", "button"})} | {t: (CLOSED_BY[t], WALLS[t]) for t in CLOSED_BY}
_STOPS = frozenset().union(*(a | b for a, b in ENDS.values()))


class Tags:
    """Where the tags of a page end: at the first > outside quotes, or, where quotes never close, at the first one at all.

    Places of quotes and brackets are listed once, and quotes and brackets from which no end was found are kept, so that a
    page's broken tags together are gone through once.
    """

    def __init__(self, html: str):
        self.html = html
        self.places: dict[str, list[int]] = {">": [], '"': [], "'": []}
        for m in re.finditer("[>\"']", html):
            self.places[m[0]].append(m.start())
        self.all = sorted(x for of in self.places.values() for x in of)
        self.dead: set[int] = set()

    def next(self, kind: list[int], at: int) -> int:
        k = bisect_left(kind, at)
        return kind[k] if k < len(kind) else -1

    def end(self, at: int) -> int:
        """The > that ends a tag whose attributes begin here; -1 without one."""
        went, y = [], self.next(self.all, at)
        while y >= 0 and y not in self.dead:
            if self.html[y] == ">":
                return y
            went.append(y)
            close = self.next(self.places[self.html[y]], y + 1)
            y = self.next(self.all, close + 1) if close >= 0 else -1
        self.dead.update(went)
        return self.next(self.places[">"], at)


class Element:
    """An element with its parent, and its path as a key: a digest of the parent's key and its own step, so that deep pages
    take no more for each element than flat ones."""

    __slots__ = ("tag", "step", "key", "parent", "out", "good", "near_good", "score", "container", "article", "box", "inside", "stops", "block", "inlines")

    def __init__(self, tag: str, step: str, parent: Element | None, out: bool, good: bool, article: bool):
        self.tag, self.step, self.parent, self.out, self.good, self.article = tag, step, parent, out, good, article
        self.key = blake2b((parent.key if parent else b"") + step.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.near_good = good or parent is not None and parent.near_good
        self.score, self.container = 0.0, tag in CONTAINER
        self.box = self if self.container or parent is None else parent.box  # the nearest container
        self.inside: bool | None = None
        # for each of ENDS the nearest element, itself included, that it ends or can't reach through
        self.stops: dict[str, Element] = parent.stops if parent else {}
        if tag in _STOPS:
            self.stops = self.stops | {kind: self for kind, (ends, walls) in ENDS.items() if tag in ends or tag in walls}
        self.block = self if tag not in INLINE or parent is None else parent.block  # the nearest element that isn't inline
        self.inlines: Counter = Counter() if self.block is self else self.block.inlines  # the open inline ones right within it

    @property
    def path(self) -> str:
        return "/".join([e.step for e in _up(self)][::-1])

    def within(self, key: bytes) -> bool:
        """Whether it or an element around it has this key; each element is asked once for one page."""
        way, e = [], self
        while e is not None and e.inside is None and e.key != key:
            way.append(e)
            e = e.parent
        found = e is not None and (e.inside if e.inside is not None else True)
        for x in way:
            x.inside = found
        return found


def _open(tag: str, attributes: str, parent: Element | None) -> Element:
    found = {}
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    words: set[str] = set()
    for name in unescape(f"{found.get('class', '')} {found.get('id', '')}").split():
        for word in map(str.lower, _PARTS.findall(name)):
            if word in TURNS:
                break
            words.add(word)
    inside = parent is not None and parent.article
    article = inside or tag == "article" or found.get("itemprop") == "articleBody"
    out = parent is not None and parent.out or tag in LEFT_OUT or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    out = out or tag == "header" and not (article or parent is not None and parent.near_good) or bool(words & MARKS) and tag not in ("html", "body", "main") or bool(_HIDDEN.search(found.get("style", "")))
    classes = ".".join(sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").lower().split()}))
    step = f"{tag}.{classes}" if classes else tag
    return Element(tag, step, parent, out, bool(words & GOOD) or tag in ("article", "main"), article)


def blocks(html: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """(the blocks outside what is left out, each with its nearest container; the containers), in page order."""
    found: list[tuple[Element, str]] = []
    containers: list[Element] = []
    root = top = Element("html", "html", None, False, False, False)
    containers.append(root)
    text: list[str] = []
    opened = Counter(["html"])  # how many elements of each kind are open
    linked = at = 0

    def flush() -> None:
        nonlocal text, linked
        block = " ".join("".join(text).split())
        if block:
            e = top.box
            found.append((e, block))
            worth = float(max(len(block) - linked, 0))
            while e is not None and worth > 1e-9:
                e.score += worth * (1.25 if e.good else 1.0)
                worth *= FADE
                e = e.parent and e.parent.box
        text, linked = [], 0

    def end(e: Element) -> None:
        """Ends all open elements down to e."""
        nonlocal top
        while top is not e.parent:
            opened[top.tag] -= 1
            if top.block is not top:
                top.inlines[top.tag] -= 1
            top = top.parent

    def ended(kind: str) -> None:
        """Ends the innermost open element that one of this kind ends, if no wall stands before it."""
        e = top.stops.get(kind)
        if e is not None and e.tag in ENDS[kind][0] and e.parent is not None:
            end(e)

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not top.out:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if opened["a"]:
                linked += len(piece.strip())

    tags, attributes = Tags(html), ""
    while m := _MARKUP.search(html, at):
        add(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        close = tags.end(at)
        if close < 0:  # no tag: its sign and name are text
            add(m[0])
            continue
        at, attributes = close + 1, html[at:close]
        if tag not in INLINE and tag != "html":
            flush()
        elif tag in ("br", "td", "th"):
            add(" ")
        if m[1]:
            e = top
            if top.inlines[tag] if tag in INLINE else opened[tag]:
                while e.parent is not None and e.tag != tag:
                    e = e.parent
            if e.parent is not None and e.tag == tag:
                if e.tag not in INLINE:
                    flush()
                end(e)
        elif tag in ("html", "body") and opened[tag]:
            continue
        elif tag in RAW:
            last = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            close = tags.next(tags.places[">"], last.end()) if last else -1
            at = close + 1 if close >= 0 else len(html)
        elif tag not in VOID and not attributes.endswith("/") or tag not in VOID and tag in CONTAINER:
            if tag not in INLINE:  # a paragraph ends where a block begins
                ended("p")
            if tag in CLOSED_BY:
                ended(tag)
            top = _open(tag, attributes, top)
            opened[tag] += 1
            if top.block is not top:
                top.inlines[tag] += 1
            if top.container and not top.out:
                containers.append(top)
    add(html[at:])
    flush()
    return found, containers


def _up(e: Element | None) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def _best(found: list, containers: list[Element]) -> Element:
    """The container that scores best, the first of equals, widened to the outermost article around it."""
    best = max(containers, key=lambda e: e.score)
    wide = [e for e in _up(best) if e.tag == "article" or e.container and e.article]
    return wide[-1] if wide else best


def best_path(html: str) -> tuple[str, bytes | None]:
    """(the path of a page's best container, its key); empty and null without text."""
    found, containers = blocks(html)
    if not found:
        return "", None
    best = _best(found, containers)
    return best.path, best.key


def text_at(html: str, key: bytes | None) -> tuple[str, bytes | None]:
    """(text, the key of where it stands): what stands in containers with this key, or in the page's own best one."""
    found, containers = blocks(html)
    if not found:
        return "", None
    if key is not None:
        held = [t for b, t in found if b.within(key)]
        if held:
            return "\n".join(held), key
        for b, _ in found:
            for e in _up(b):
                if e.inside is None:
                    break
                e.inside = None
    key = _best(found, containers).key
    return "\n".join(t for b, t in found if b.within(key)), key


def host_of(url: str = "url"):
    """The lower-case host of a url column, without www. and port; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\d?\.", "")


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, n): how many of a host's pages have their text at a path."""

    def voted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [best_path(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in got], pa.string()), pa.array([k for _, k in got], pa.binary())], ["host", "path", "key"])

    rows = pages.select(host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(voted, "host string, path string, key binary").filter("path <> ''").groupBy("host", "path", "key").agg(F.count("*").alias("n"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, path, key): each host's path with most votes, the first of equals."""
    return counted.groupBy("host").agg(F.max_by(F.struct("path", "key"), F.struct("n", F.reverse("path"))).alias("won")).select("host", "won.path", "won.key")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, from_host of each row of pages (page_id, url, html); from_host: whether the text stands at
    the path that the page's host has voted for.

    The few winners are written, so that Spark knows their size and sends them to the pages where that is small; where it
    isn't, it sorts both sides by host, and splits hosts that are too large for one task.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(3).to_pylist()
            got = [text_at(h, k) for h, k in zip(batch.column(2).to_pylist(), keys)]
            same = [k is not None and k == at for k, (_, at) in zip(keys, got)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array(same, pa.bool_())], ["page_id", "url", "text", "n_chars", "from_host"])

    won = written(winners(votes(pages)), "host-paths").select("host", "key")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    rows = rows.join(won, "host", "left").select("page_id", "url", "html", "key")
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long, from_host boolean")
