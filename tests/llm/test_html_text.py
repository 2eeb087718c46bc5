"""Text of pages: odd markup, boilerplate, and hosts' votes."""

import html
import random
import re
import time
from collections import Counter

import pytest

from quire.llm.html_text import best_path, blocks, extract, text_at, votes, winners

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>unclosed <b>bold", "unclosed bold"), ("<!-- unclosed", ""), ("<script>never closed", ""), ("a < b and c > d", "a < b and c > d"),
        ('<a title="x>y">t</a> z', "t z"), ("<div><p>a</div></p>b", "a\nb"), ("<p hidden>x</p><p>y</p>", "y"), ("<p>a<br>b&nbsp; c</p>", "a b c"), ("<ul><li>one<li>two</ul>", "one\ntwo"),
        ("<article><p>x</p><div class='comments'><p>no</p></div><p>y</p></article>", "x\ny"), ("<main><h1>T</h1><p>b</p></main><footer>f</footer>", "T\nb"), ("<article><header><h1>T</h1></header><p>b</p><form>f</form></article>", "T\nb"),
        ("<body><header><p>site</p></header><div class='cookie-notice'>c</div><div class=content><p>long enough text</p></div><aside>s</aside></body>", "long enough text"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("<p>x</p><SCRIPT>var t='</p>'</SCRIPT><p>y</p>", "x\ny"), ("</div></p>x", "x"), ("<p>&eacute;&#233;&#xe9;</p>", "ééé"), ("<div style='display: none'>h</div><p>s</p>", "s"),
    ],
)
def test_text(page, text):
    assert text_at(page, None)[0] == text


@pytest.mark.parametrize("page,text", [("<div>" * 30_000 + "deep", "deep"), ("<span>" * 30_000 + "<p>a</p></b></b>" * 3000, "\n".join(["a"] * 3000)), ("<p>x" * 30_000, "\n".join(["x"] * 30_000)), ("<b>" * 20_000 + "</i>" * 20_000 + "t", "t"), ("w " * 1_000_000, ("w " * 1_000_000).strip())])
def test_deep_and_long(page, text):
    path, key = best_path(page)
    assert text_at(page, None)[0] == text_at(page, key)[0] == text_at(page, b"no such key")[0] == text and path.startswith("html")


def test_consensus(spark):
    usual = "<html><body><div class='box'><p>%s</p></div><div class='talk9'><p>%s</p></div></body></html>"
    pages = [(i, f"http://www.h.org:80/{i}", usual % ("article text that is long " * 3, "short"), "x") for i in range(4)]
    pages += [(9, "https://h.org/9", usual % ("brief", "a much longer reader's letter " * 9), "x"), (10, None, "<p>alone</p>", "y"), (11, "http://h.org/11", None, "z"), (9, "https://h.org/9", usual % ("brief", "a much longer reader's letter " * 9), "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, path string").repartition(3)
    assert {(r.host, r.path) for r in winners(votes(df)).collect()} == {("h.org", "html/body/div.box"), ("", "html")}
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract(df).collect())
    assert [g[1] for g in got if g[0] == 9] == ["brief", "brief"] and (10, "alone", 5) in got and (11, "", 0) in got
    assert best_path(pages[4][2])[0] == "html/body/div.talk#"
    assert all(r.from_host for r in extract(df.filter("html is not null")).collect())
    assert extract(df.limit(0)).collect() == []


def test_tables_pages(spark):
    """The pages of the test tables have their text in one article, in h1 and p elements."""
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in extract(df).collect()}
    for r in df.collect():
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize(
    "unit", ["<p", "<a ", '<a "', "<a '", '<a href="x', "<!--", "</script ", "<script ", '<b ">"', "<b \">'<i '", "<", "</", "<!", "<div class=\"", "<p>x</i>", "<i><div><b>", "&amp", "<b></i></b><li>"]
)
def test_broken_markup_is_linear(unit):
    page = (unit * (1_000_000 // len(unit)))[:1_000_000]
    for html_ in (page, page + ">", "<script>" + page, "<p>" + page + '">'):
        began = time.process_time()
        blocks(html_)
        assert time.process_time() - began < 8, unit


@pytest.mark.parametrize("page", ["<i><div>" + "<b>" * 20_000 + "</i>" * 20_000 + "t", "<p><button>" + "<span>" * 20_000 + "<div></div>" * 20_000, "<tr><table>" + "<span>" * 20_000 + "<ol></ol>" * 20_000, "<li><ul>" + "<b>" * 20_000 + "<u></li></u>" * 20_000])
def test_deep_markup_is_linear(page):
    began = time.process_time()
    blocks(page)
    assert time.process_time() - began < 4


@pytest.mark.parametrize("page,text", [("x <p y", "x <p y"), ('<a "t>u', "u"), ('<a "t>u "v>w', "w"), ("<p class='x>y</p>z", "y\nz"), ("a <b\nc", "a <b c"), ("<p<b>x", "x")])
def test_broken_tags(page, text):
    assert text_at(page, None)[0] == text


def tree(rng, depth):
    """(tag, class, children): children are texts or trees."""
    kids = []
    for _ in range(rng.randint(1, 4)):
        kids.append(tree(rng, depth - 1) if depth and rng.random() < 0.6 else "w" * rng.randint(1, 60))
    return rng.choice(["div", "section", "p"]) if depth else "p", rng.choice(["", "box", "body", "c1", "c2"]), kids


def shown(t):
    tag, name, kids = t
    inside = "".join(k if isinstance(k, str) else shown(k) for k in kids)
    return f"<{tag} class='{name}'>{inside}</{tag}>" if tag != "p" else "".join(f"<p>{k}</p>" if isinstance(k, str) else shown(k) for k in kids)


def scores(t, path, above, out):
    """Every container's path and score by plain recursion: a block counts for all containers around it, fading outwards."""
    tag, name, kids = t
    if tag != "p":
        step = f"{tag}.{re.sub('[0-9]+', '#', name)}" if name else tag
        path = f"{path}/{step}"
        above = [len(out), *above]
        out.append([path, 0.0, 1.25 if name == "body" else 1.0])
    joined = []
    for k in kids:
        if isinstance(k, str):
            if tag != "p" and joined and joined[-1] is not None:
                joined[-1] += k
            else:
                joined.append(k)
        else:
            joined.append(None)
            scores(k, path, above, out)
    for text in joined:
        if text is not None:
            for i, c in enumerate(above):
                out[c][1] += len(text) * 0.6**i * out[c][2]


def test_votes_by_plain_search(spark):
    rng, rows, want = random.Random(3), [], Counter()
    for i in range(120):
        t = tree(rng, 3)
        host = f"h{i % 4}.org"
        found = [["html", 0.0, 1.0]]
        scores(t, "html", [0], found)
        best = max(range(len(found)), key=lambda c: (round(found[c][1], 6), -c))
        rows.append((i, f"http://{host}/{i}", shown(t)))
        want[host, found[best][0]] += 1
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {(r.host, r.path): r.n for r in votes(df).collect()} == dict(want)
    top = {h: max(((n, p[::-1]) for (g, p), n in want.items() if g == h))[1][::-1] for h in {h for h, _ in want}}
    assert {r.host: r.path for r in winners(votes(df)).collect()} == top
