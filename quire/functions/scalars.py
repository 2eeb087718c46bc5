"""Column functions on text, colours and boxes, of built-in functions alone; white space is always spelled out.

Patterns loop possessively or over single classes, so that no text is too long for them, and edges are found by a look
behind, so that runs of white space inside a text are passed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: White space as browsers' regular expressions see it.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
#: Fixed value: punctuation that may stand at a word's edge.
EDGE = r"""[\s"'“”‘’()\[\]{}「」『』《》〈〉.,!?;:…·]"""
_SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_EDGE_CHARS = "\t\n\x0b\f\r " + EDGE[3:-1].replace("\\", "")
CLASSES = {"hangul": r"[가-힣ㄱ-ㆎ]", "han_kana": r"[一-鿿぀-ヿ㐀-䶿]", "latin": r"[A-Za-zÀ-ɏ]", "digit": r"[0-9]"}
#: Particles that follow a noun without a space.
PARTICLES = ("에서부터", "으로부터", "에게서", "으로서", "으로써", "에서", "에게", "까지", "부터", "처럼", "보다", "께서", "으로", "을", "를", "은", "는", "의", "에", "와", "과", "로", "만", "도")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_class(text: Column | str, kind: str) -> Column:
    return _c(text).rlike(CLASSES[kind])


def class_count(text: Column | str, *kinds: str) -> Column:
    """How many code points of the classes a text has."""
    return F.length(_c(text)) - F.length(F.regexp_replace(_c(text), "|".join(CLASSES[k] for k in kinds), ""))


def script_share(text: Column | str, *kinds: str) -> Column:
    """Share of the classes among letters and digits; 0.5 where there are none."""
    known = class_count(text, *CLASSES)
    return F.when(known > 0, class_count(text, *kinds) / known).otherwise(F.lit(0.5))


def trimmed(text: Column | str) -> Column:
    """A text without white space at its ends; a pattern would look behind each of its characters."""
    return F.btrim(_c(text), F.lit(_SPACE_CHARS))


def has_ink(text: Column | str) -> Column:
    """Whether a text is more than white space."""
    return _c(text).rlike(f"[^{SPACE[1:]}")


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def digits_masked(text: Column | str) -> Column:
    """Runs of digits as #, without white space around."""
    return trimmed(F.regexp_replace(_c(text), "[0-9]+", "#"))


def word_core(token: Column | str) -> Column:
    """A token without soft hyphens and edge punctuation."""
    return F.btrim(F.replace(_c(token), F.lit("\u00ad")), F.lit(_EDGE_CHARS))


def stem(token: Column | str) -> Column:
    """A token without its longest particle, if something is left before it."""
    longest = sorted(PARTICLES, key=len, reverse=True)
    return F.regexp_replace(_c(token), rf"(?<=.)(?:{'|'.join(longest)})\z", "")


def escaped(text: Column | str, quotes: bool = True) -> Column:
    """Text for HTML or XML: & < > and, with quotes, the double quote."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;")] * quotes
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, _c(text))


def mark_shape(mark: Column | str) -> Column:
    """A list mark with digits and letters by kind, so that marks of one list look alike."""
    kinds = [("[0-9]+", "9"), ("[a-z]", "a"), ("[A-Z]", "A"), ("[가-힣]", "가"), ("[ㄱ-ㅎ]", "ㄱ"), ("[①-⑳]", "①"), ("[⑴-⒇]", "⑴"), ("[ⓐ-ⓩ]", "ⓐ"), ("[一二三四五六七八九十]", "一")]
    return reduce(lambda t, k: F.regexp_replace(t, k[0], k[1]), kinds, _c(mark))


def mark_order(mark: Column | str) -> Column:
    """The place of a mark in its sequence, from 1; null for bullets."""
    core = F.regexp_replace(_c(mark), r"[.)(\s]", "")
    rows = ("가나다라마바사아자차카타파하", "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "一二三四五六七八九十")
    starts = (("①", 20), ("⑴", 20), ("ⓐ", 26), ("Ⓐ", 26))
    code = F.ascii(core)
    single = F.length(core) == 1
    out = F.when(core.rlike("^[0-9]+\\z"), core.try_cast("int"))
    for row in rows:
        out = out.when(single & F.lit(row).contains(core), _place(row, core))
    for first, n in starts:
        out = out.when(single & code.between(ord(first), ord(first) + n - 1), code - (ord(first) - 1))
    return out


def _place(row: str, one: Column) -> Column:
    return F.call_function("instr", F.lit(row), one)


#: The signs and letters that list marks are made of.
BULLETS = "•●○◦▪■□◆◇▶▷►‣★☆※\\-–"
_SPACE = "[ \\u00a0]"
_MARK = (
    rf"^(?:[{BULLETS}]{_SPACE}++|[0-9]{{1,2}}[.)]{_SPACE}++|\([0-9]{{1,2}}\){_SPACE}*+|[①-⑳]{_SPACE}*+"
    rf"|[가나다라마바사아자차카타파하a-hA-H][.)]{_SPACE}++)(?=\S)"
)


def is_list_line(text: Column | str) -> Column:
    """Whether a line begins with a list mark."""
    return _c(text).rlike(_MARK)


#: Bullets, rows of numbering letters and signs, and the marks that lines of a list may begin with.
LIST_BULLETS = "•●○◦▪■□◆◇▶▷►‣⁃∙❧❖➢✓✔★☆♢♦◈▣◾◽❑➔➡ㅇ\\-–"
SYLLABLES, JAMO, NUMERALS = "가나다라마바사아자차카타파하", "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ", "一二三四五六七八九十"
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")
_LIST_MARK = (
    rf"^(?:[·ㆍ・•]{_SPACE}*+(?=[\p{{L}}\p{{N}}])|[{LIST_BULLETS}]{_SPACE}++(?=\S)|[0-9]{{1,2}}[.)]{_SPACE}++(?=\S)|\([0-9]{{1,2}}\){_SPACE}*+(?=\S)|[⑴-⒇①-⑳㉠-㉭㉮-㉻ⓐ-ⓩⒶ-Ⓩ]{_SPACE}*+(?=\S)"
    rf"|[{NUMERALS}][.)]{_SPACE}*+(?=\S)|(?:[{SYLLABLES}]|[{JAMO}]|i{{1,3}}|iv|vi{{0,3}}|ix|xi{{0,2}}|I{{1,3}}|IV|VI{{0,3}}|IX|XI{{0,2}}|[a-hA-H])[.)]{_SPACE}++(?=\S))"
)
#: Signs that hold a number, by their first one, how many there are, and their list's key.
_RINGED = (("⑴", 20, "n0()"), ("①", 20, "n1"), ("㉠", 14, "nA."), ("㉮", 14, "nA."), ("ⓐ", 26, "nA."), ("Ⓐ", 26, "nA."))


def list_mark(text: Column | str) -> Column:
    """struct(kind, key, value, length) of the mark a line begins with: b for bullets, n for numbers; null where there is none.

    Marks of one list have one key: b and the bullet (middle dots count as •), or n, the way of numbering (0 digits, 1 ringed,
    2 and 3 Roman, 4 and 5 letters, 8 syllables, 13 numerals, A what is shown as letters instead) and the sign behind it.
    """

    def of(mark: Column) -> Column:
        core, sep = F.regexp_extract(mark, r"^\(?([^.)\s\u00a0]+)", 1), F.regexp_extract(mark, "[.)]", 0)
        return F.when(mark != "", let(F.struct(core.alias("core"), sep.alias("sep"), F.ascii(core).alias("code"), F.length(mark).alias("length"), mark.startswith("(").alias("inside")), found))

    def found(m: Column) -> Column:
        core, sep, code = m["core"], m["sep"], m["code"]
        place = lambda row: F.array_position(F.array(*map(F.lit, row)), core)
        row = lambda letters: F.lit(letters).contains(core) & (F.length(core) == 1)
        lower, upper = ROMAN, tuple(r.upper() for r in ROMAN)
        cases = [(core.rlike("^[·ㆍ・•]\\z"), F.lit("b•"), None), (core.rlike(rf"^[{LIST_BULLETS}]\z"), F.concat(F.lit("b"), core), None), (core.rlike("^[0-9]+\\z"), F.concat(F.lit("n0"), F.when(m["inside"], "()").otherwise(sep)), core.try_cast("int"))]
        cases += [(code.between(ord(a), ord(a) + n - 1), F.lit(key), code - (ord(a) - 1)) for a, n, key in _RINGED]
        cases += [(row(letters), F.concat(F.lit(key), sep), _place(letters, core)) for letters, key in ((SYLLABLES, "n8"), (NUMERALS, "n13"), (JAMO, "nA"))]
        cases += [(F.array_contains(F.array(*map(F.lit, row_of)), core), F.concat(F.lit(key), sep), place(row_of)) for row_of, key in ((lower, "n3"), (upper, "n2"))]
        cases += [(core.rlike("^[a-h]\\z"), F.concat(F.lit("n5"), sep), code - 96), (core.rlike("^[A-H]\\z"), F.concat(F.lit("n4"), sep), code - 64)]
        key, value = F.lit(None).cast("string"), F.lit(None).cast("int")
        for test, k, v in reversed(cases):
            key = F.when(test, k).otherwise(key)
            value = F.when(test, F.lit(None).cast("int") if v is None else v.cast("int")).otherwise(value)
        return F.struct(F.when(F.substring(key, 1, 1) == "b", "b").otherwise("n").alias("kind"), key.alias("key"), value.alias("value"), m["length"].alias("length"))

    return let(F.regexp_extract(_c(text), _LIST_MARK, 0), of)


#: Four dot leaders or more, blanks between them or not, then a page number. Each run of leaders and blanks is looked at once.
TOC = r"(?<![.·…‥・_ ])(?=(?:[ ]*+[.·…‥・_]){4})[.·…‥・_ ]++([0-9]{1,4}|[ivxlcIVXLC]{1,6})[ ]*+$"


def is_toc_line(text: Column | str) -> Column:
    # most lines have no two leaders beside each other, which is seen without a look around each character
    return _c(text).rlike(r"[.·…‥・_][ ]*+[.·…‥・_]") & _c(text).rlike(TOC)


def toc_entry(text: Column | str) -> Column:
    """struct(title, page) of a line that ends in dot leaders and a page number."""
    return F.when(is_toc_line(text), F.struct(F.regexp_replace(F.regexp_replace(_c(text), TOC, ""), r"[ \t]+$", "").alias("title"), F.regexp_extract(_c(text), r"([0-9]{1,4}|[ivxlcIVXLC]{1,6})[ ]*$", 1).alias("page")))


def is_label_line(text: Column | str) -> Column:
    """A short name, a colon and a value; a colon between digits (times, ratios) is none."""
    return _c(text).rlike(r"^[^\s:：.!?。][^:：.!?。]{0,18}\s*[:：]\s+\S") & ~_c(text).rlike(r"^[^:：]*[0-9]\s*[:：]\s*[0-9]")


def heading_level(text: Column, size: Column, body: Column, lines: Column, bold: Column, centred: Column) -> Column:
    """0 for body text, else 1 to 3, from the size against the body's, weight, alignment, capitals and length."""
    ratio = size / F.greatest(body, F.lit(1.0))
    chars = F.length(F.regexp_replace(text, rf"{SPACE}+", ""))
    latin = F.regexp_replace(text, "[^A-Za-z]", "")
    capitals = (F.length(latin) >= 4) & (latin == F.upper(latin))
    label = text.rlike(r"^[^\s:：.!?。][^:：.!?。]{0,18}\s*[:：]\s*\S")
    return (
        F.when((chars == 0) | (chars > 120) | (lines > 3), 0)
        .when((chars > 55) & text.rlike("[.!?。！？]\\z") & (ratio < 1.4), 0)
        .when(label & (ratio < 1.17), 0)
        .when(ratio >= 1.65, 1).when(ratio >= 1.38, 2).when(ratio >= 1.17, 3)
        .when((ratio >= 1.06) & (bold | centred | capitals), 3)
        .when((lines == 1) & (chars <= 55) & bold & (ratio >= 0.96), 3)
        .otherwise(0)
    )


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.3 * r + 0.59 * g + 0.11 * b


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(x.cast("long")), 2, "0")) for x in (r, g, b)))


def overlap_area(a: str, b: str) -> Column:
    """Area that two boxes share; a and b: prefixes of columns x0, y0, x1, y1."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)))
    return side("x0", "x1") * side("y0", "y1")


def box_area(a: str) -> Column:
    return (F.col(a + "x1") - F.col(a + "x0")) * (F.col(a + "y1") - F.col(a + "y0"))


def half_up(x: Column) -> Column:
    """Rounds halves upwards, below zero too."""
    return F.floor(x + 0.5)


def nearest_rank(values: Column, p: float) -> Column:
    """The element of a sorted array at the rounded place (n - 1) * p; 0 of an empty one."""
    n = F.size(values)
    return F.coalesce(F.get(values, half_up((n - 1) * p).cast("int")), F.lit(0.0))


def upper_median(values: Column) -> Column:
    """The element of a sorted array at n div 2; null of an empty one."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def floor_quantile(values: Column, p: float) -> Column:
    """The element of a sorted array at floor(p n), the last at most."""
    return F.get(values, F.least(F.size(values) - 1, F.floor(F.size(values) * p).cast("int")))


def duration_text(ms: Column) -> Column:
    """Whole seconds as h:mm:ss or m:ss."""
    s = F.floor(ms / 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def page_list(raw: Column | str, last: Column | None = None) -> Column:
    """"1-3, 5" as sorted distinct page numbers from 0; turned-round ranges are turned back. Null if a part is no range, or
    has a page that isn't between 1 and `last`, the document's number of pages; without it, pages are numbers of up to nine digits."""
    parts = F.filter(F.transform(F.split(_c(raw), ","), lambda p: F.trim(p)), lambda p: p != "")
    pattern = r"^([0-9]+)(?:\s*-\s*([0-9]+))?$"
    bad = F.exists(parts, lambda p: ~p.rlike(pattern)) | (F.size(parts) == 0)

    def pages(p: Column) -> Column:
        a = F.regexp_extract(p, pattern, 1).try_cast("int")
        b = F.when(F.regexp_extract(p, pattern, 2) == "", a).otherwise(F.regexp_extract(p, pattern, 2).try_cast("int"))
        return F.when((F.least(a, b) >= 1) & (F.greatest(a, b) <= (F.lit(999_999_999) if last is None else last)) & a.isNotNull() & b.isNotNull(), F.sequence(F.least(a, b) - 1, F.greatest(a, b) - 1))

    listed = F.transform(parts, pages)
    return F.when(~bad & ~F.exists(listed, lambda x: x.isNull()), F.array_sort(F.array_distinct(F.flatten(listed))))


def is_good_url(url: Column | str) -> Column:
    return _c(url).rlike(r"^https?://[^\s/?#]+\.[^\s]+$")


def same_list_next(before: Column | str, mark: Column | str) -> Column:
    """Whether a mark follows another in one list: the same shape and the next place, or the same bullet."""

    def of(marks: Column) -> Column:
        a, b = marks["a"], marks["b"]
        next_one = let(F.struct(mark_order(a).alias("x"), mark_order(b).alias("y")), lambda o: F.when(o["x"].isNull() & o["y"].isNull(), a == b).otherwise(F.coalesce(o["y"] == o["x"] + 1, F.lit(False))))
        return (mark_shape(a) == mark_shape(b)) & next_one

    return let(F.struct(_c(before).alias("a"), _c(mark).alias("b")), of)


def decoded_entities(text: Column | str) -> Column:
    """Text with the references of HTML that a plain text needs (amp, lt, gt, quot, #39, numbers) as characters; all others,
    and numbers that are no character, stay as they are."""
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'"}

    def one(part: Column) -> Column:
        head = F.lower(F.regexp_extract(part, r"^([A-Za-z]+|#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7});", 1))
        code = F.when(head.startswith("#x"), F.conv(F.substring(head, 3, 8), 16, 10).cast("long")).when(head.startswith("#"), F.substring(head, 2, 8).cast("long"))
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.regexp_replace(part, "^[^;]*;", "")
        out = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.concat(sign, rest))
        for name, value in reversed(named.items()):
            out = F.when(head == name, F.concat(F.lit(value), rest)).otherwise(out)
        return F.coalesce(out, F.concat(F.lit("&"), part))

    def all_of(parts: Column) -> Column:
        return F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))

    return let(F.split(_c(text), "&"), all_of)


def _family(name: Column) -> Column:
    """A font's name without the six letters of a subset."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def is_bold_font(name: Column | str) -> Column:
    """Whether a font's name says that it is bold."""
    n = _family(_c(name))
    return n.rlike("(?i)bold|black|heavy|semibold|extrabold|굵") | n.rlike(r"[a-z](?:B|EB|XB|SB|Bd|Bk)\z") | n.rlike(r"(?i)[-_ ](?:B|EB|XB|SB)\z")


def font_css(name: Column | str) -> Column:
    """The CSS font list for a font's name: the family, with spaces too, and fonts of its kind."""
    n = F.coalesce(_c(name), F.lit(""))
    base = F.regexp_replace(_family(n), r"[-,](Bold|Regular|Medium|Light|SemiBold|ExtraBold|Italic|[a-z]{1,2}[A-Z][a-z]+).*\z", "")
    quoted = lambda x: F.when(x != "", F.concat(F.lit('"'), x, F.lit('"')))
    # Names of serif fonts, and what stands in for both kinds.
    serif = n.rlike("(?i)myeong|batang|serif|book|명조|바탕|gowun|times|mincho")
    kind = F.when(serif, '"Noto Serif KR","Noto Serif CJK KR","Nanum Myeongjo","Batang",serif').otherwise('"Noto Sans KR","Noto Sans CJK KR","Nanum Gothic","Malgun Gothic",sans-serif')
    return F.concat_ws(",", quoted(base), quoted(F.regexp_replace(base, "([a-z])([A-Z])", "$1 $2")), kind)


def result_at(data: Column | str, path: str = "") -> Column:
    """The text at a dotted path of a JSON text; without a path, at the usual places of an answer, else the JSON as it is."""
    at = lambda p: F.get_json_object(_c(data), "$." + p)
    if path:
        return at(".".join(p for p in path.split(".") if p))
    usual = ("output", "result", "text", "message", "data.output", "data.text")  # fixed values
    return F.coalesce(*(at(p) for p in usual), _c(data))


def filled(template: Column | str, **values: Column) -> Column:
    """A template with {{name}} filled in; one that names no text gets it at its end."""
    t, text = _c(template), values.get("text", F.lit(""))
    whole = F.when(t.contains("{{text}}"), t).otherwise(F.concat(t, F.lit("\n\n"), text))
    return reduce(lambda x, kv: F.replace(x, F.lit("{{%s}}" % kv[0]), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), whole)


def svg_size(svg: Column | str) -> Column:
    """struct(width, height) of an SVG: its view box, else its attributes, else those of a page (595 by 842)."""
    tag = F.regexp_extract(_c(svg), r"(?i)<svg\b[^>]*>", 0)
    box = r"""(?i)\bviewBox=["']\s*[0-9.+-]+\s+[0-9.+-]+\s+([0-9.+-]+)\s+([0-9.+-]+)["']"""
    pick = lambda i, name, usual: F.coalesce(*(F.nullif(F.regexp_extract(tag, p, k).try_cast("double"), F.lit(0.0)) for p, k in ((box, i), (rf"""(?i)\b{name}=["']([0-9.+-]+)""", 1))), F.lit(usual))
    return F.struct(pick(1, "width", 595.0).alias("width"), pick(2, "height", 842.0).alias("height"))


def word_at(text: Column | str, at: Column) -> Column:
    """struct(start, length) of the word (letters, digits, _) around a place of a text, or right before it; null where none is."""
    t = _c(text)
    at = F.least(at, F.length(t))
    left = F.length(F.regexp_extract(F.left(t, at), r"[\p{L}\p{N}_]*\z", 0))
    right = F.length(F.regexp_extract(F.substring(t, at + 1, F.length(t)), r"^[\p{L}\p{N}_]*", 0))
    return F.when(left + right > 0, F.struct((at - left).alias("start"), (left + right).alias("length")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def composed(first: Column, second: Column) -> Column:
    """Two affine maps (arrays a, b, c, d, e, f) as one: the first one's, then the second one's."""
    m, n = (lambda i: F.get(first, i)), (lambda i: F.get(second, i))
    pair = lambda x, y, j: m(x) * n(j) + m(y) * n(j + 2)
    return F.array(pair(0, 1, 0), pair(0, 1, 1), pair(2, 3, 0), pair(2, 3, 1), pair(4, 5, 0) + n(4), pair(4, 5, 1) + n(5))


def moved(matrix: Column, x: Column, y: Column) -> Column:
    """struct(x, y): where an affine map takes a point."""
    m = lambda i: F.get(matrix, i)
    return F.struct((m(0) * x + m(2) * y + m(4)).alias("x"), (m(1) * x + m(3) * y + m(5)).alias("y"))


#: What the letters of two symbol fonts show.
WINGDINGS = {'"': "✂", "#": "✁", "(": "☎", ")": "✆", "*": "✉", ",": "📪", "-": "📫", "l": "●", "n": "■", "o": "□", "q": "❑", "u": "◆", "v": "❖", "w": "⬥", "§": "▪", "Ø": "➢", "ü": "✓", "û": "✗", "ý": "☒", "þ": "☑", "¨": "◻", "J": "☺", "L": "☹", "F": "☞", "à": "➔", "è": "➡"}
ZAPF = {"l": "●", "n": "■", "o": "❏", "q": "❑", "u": "◆", "H": "★", "I": "✩", "s": "▲", "t": "▼", "3": "✓", "4": "✔", "7": "✗", "8": "✘", "+": "☛"}


def symbol_sign(font: Column, sign: Column) -> Column:
    """The sign that a symbol font shows for a letter: by the two known tables, else an ornament or a bullet; other fonts,
    white space and characters beyond Latin-1 stay as they are. Private code points of symbol fonts count as their letters."""
    code = F.conv(F.hex(F.encode(F.substring(sign, 1, 1), "UTF-32")), 16, 10).cast("int")
    code = F.when(code.between(0xF020, 0xF0FF), code - 0xF000).otherwise(code)
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    of = lambda known: F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), letter)
    named = lambda p: font.rlike("(?i)" + p)
    shown = F.coalesce(F.when(named("wingding"), of(WINGDINGS)), F.when(named("zapf|dingbat"), of(ZAPF)), F.when(named("ornament|fleuron"), "❧").otherwise("•"))
    stays = ~named(r"ornament|dingbat|wingding|webding|zapf|fleuron|bullets?\b") | (sign == "") | sign.rlike(r"^\s") | ~code.between(0x21, 0xFF)
    return F.when(stays, sign).otherwise(shown)


def pasted_html(text: Column | str) -> Column:
    """A text as a fragment of HTML to paste: a paragraph for each line."""
    lines = F.split(F.regexp_replace(_c(text), "\r\n?", "\n"), "\n")
    return F.concat(F.lit("<!--StartFragment-->"), F.array_join(F.transform(lines, lambda t: F.concat(F.lit("<p>"), F.when(t == "", "<br>").otherwise(escaped(t, quotes=False)), F.lit("</p>"))), ""), F.lit("<!--EndFragment-->"))


def fitted_width(width: Column, fit: Column, *keys: str, body: float) -> Column:
    """A cell's width in a table (keys) brought to the body's: tables that are to fit, and those that are too wide."""
    total = F.sum(width).over(Window.partitionBy(*keys))
    return F.when((total > 0) & (fit | (total > body)), width * (body / total)).otherwise(width)


#: Groups of languages that one recogniser reads, by their codes.
LANGUAGE_PACKS = {
    "korean": "kor", "cjk": "jpn chi_sim chi_tra",
    "latin": "afr aze bos cat ces cym dan deu spa est eus fin fra gle glg hrv hun ind isl ita kur lat ltz lit lav mri msa mlt nld nor oci pol por que roh ron srp_latn slk slv sqi swe swa tgl tur uzb vie",
    "cyrillic": "bel bul mon kaz kir tgk mkd tat chv bak udm kom oss bua kal tuv sah kaa srp", "eastSlavic": "rus ukr", "arabic": "ara fas urd uig pus snd", "devanagari": "hin mar nep san bih", "thai": "tha", "greek": "ell grc", "tamil": "tam", "telugu": "tel",
}


def language_packs(codes: Column) -> Column:
    """The groups that read any of an array of language codes; English alone needs its own."""
    found = F.array_compact(F.array(*(F.when(F.arrays_overlap(codes, F.array(*map(F.lit, of.split()))), F.lit(pack)) for pack, of in LANGUAGE_PACKS.items())))
    return F.when((F.size(found) == 0) & F.array_contains(codes, "eng"), F.array(F.lit("english"))).otherwise(found)
