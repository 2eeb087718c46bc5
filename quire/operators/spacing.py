"""Spaces of recognised lines looked at again, by signs, by the document's own words, and by the width of gaps.

lines: (doc_id, line_no, text, info), info having a struct (p, g, src) for the gap behind each character that isn't white space, but for the last one: how
likely a space is, how wide the gap is by the line's height, and what put a space there (model, p, gap, or null).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.functions.scalars import SPACE

LINE = ["doc_id", "line_no"]
#: Units that stand right behind a number, particles, and signs at a word's edges.
_UNITS = "인|명|개|년|월|일|세|원|층|호|차|회|번|장|권|쪽|시|분|초|평|대|건|종"
UNIT = rf"^(?:{_UNITS}|가지|퍼센트)(?![가-힣])|^(?:{_UNITS})[이가은는을를의에과와도만]"
PARTICLES = "으로부터|에서부터|으로서|으로써|에게서|에서|에게|으로|부터|까지|마저|조차|처럼|보다|이나|이며|이고|에는|에도|와는|과는|은|는|이|가|을|를|의|에|와|과|도|로|만|나"
EDGE = r"[\s\"'“”‘’()\[\]{}<>«»「」『』·,.:;!?…~\-]"
HANGUL = "[가-힣]"
_ENDINGS = frozenset(PARTICLES.split("|"))
_EDGE_CHARS = " \t\n\x0b\f\r\"'“”‘’()[]{}<>«»「」『』·,.:;!?…~-"
_SPACES, _UNIT, _HANGUL = re.compile(SPACE), re.compile(UNIT), re.compile(HANGUL)
#: What each character is: white space, Hangul, a letter or digit (Hangul, too), a sign that a space may follow, and one that may tell; where none of these tells, and
#: what was read is sure, nothing changes.
BLANK, SYLLABLE, LETTER, PAUSE, SIGN = 1, 2, 4, 8, 16
_KINDS = np.zeros(0x110000, np.uint8)
_KINDS[[c for c in range(0x10000) if _SPACES.match(chr(c))]] = BLANK
_KINDS[0xAC00:0xD7A4] = SYLLABLE | LETTER
for _first, _last in ("09", "AZ", "az"):
    _KINDS[ord(_first) : ord(_last) + 1] = LETTER
for _chars, _kind in ((".,:)", PAUSE), (".!?,0123456789", SIGN)):
    _KINDS[[ord(c) for c in _chars]] |= _kind
#: What put a space there: nothing, the chance or the gap, the model, or something else.
NONE, GUESSED, MODEL, OTHER = 0, 1, 2, 3


def core(word: str) -> str:
    return word.strip(_EDGE_CHARS)


def stripped(word: str) -> str:
    """A word without its particle, unless nothing is left."""
    for n in (4, 3, 2, 1):
        if len(word) > n and word[-n:] in _ENDINGS and word[-n - 1] not in "\n\r\x85\u2028\u2029":
            return word[:-n]
    return word


def document_words(texts: list[str | None]) -> tuple[Counter, Counter]:
    """(tokens, pairs): how often words stand in a document, each counted once as it is and once without its particle, and
    how often two of them stand beside each other."""
    counted, pairs = Counter(), Counter()
    for text in texts:
        words = [w for w in map(core, _SPACES.sub(" ", text or "").split(" ")) if w]
        counted.update(words)
        pairs.update(pairwise(words))
    tokens = Counter(counted)
    for w, n in counted.items():
        tokens[stripped(w)] += n
    return tokens, pairs


def by_signs(c: str, after: str, two: str, before: str, before2: str, k: int) -> bool | None:
    """Whether a space belongs behind a line's character c, the k-th from 0, by the ones around it: after a sentence's end, a line's number or a comma before Hangul; none between a
    number and its unit. Else None. two: the two characters behind it; before2: the one before `before`."""
    hangul = "가" <= after <= "힣"
    if hangul and (c == "," or c in ".!?" and "가" <= before <= "힣" or c == "." and before in _DIGITS and (k == 1 or before2 not in _DIGITS and before2 != ".")):
        return True
    return False if c in _DIGITS and _UNIT.search(two) else None


_DIGITS = frozenset("0123456789")


def _refined(text: str, p: np.ndarray, g: np.ndarray, src: np.ndarray, word: float, tokens: Counter, pairs: Counter) -> tuple[str, int]:
    """A line as it should be, and how many spaces were put or taken."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KINDS[codes]
    ink = (kinds & BLANK) == 0
    chars, kinds = codes[ink], kinds[ink]
    n = len(chars)
    if n < 2 or len(g) != n - 1:
        return text, 0
    sp = np.append(~ink[1:], False)[ink]
    hangul = (kinds & SYLLABLE) != 0
    t = chars.tobytes().decode("utf-32-le", "surrogatepass")
    if n >= 3 and sp[:-1].all() and hangul.sum() >= 3:
        usual = np.sort(g)[(n - 1) // 2]
        return (t, n - 1) if usual < word else (text, 0)
    sp = sp[:-1]
    stays = sp & hangul[:-1] & hangul[1:] & ~(g < word)
    meant = ((kinds[:-1] & (LETTER | PAUSE)) | (kinds[1:] & LETTER)) != 0
    unsure = np.where(sp, src == GUESSED, (p >= 0.02) | (g >= 0.25))
    open_ = np.flatnonzero(~stays & meant & (unsure | ((kinds[:-1] & SIGN) != 0)))
    if not len(open_):
        return text, 0
    rules = {}
    for k, sure in zip(open_.tolist(), (~unsure[open_]).tolist()):
        rule = by_signs(t[k], t[k + 1], t[k + 1 : k + 3], t[k - 1] if k else "", t[k - 2] if k > 1 else "", k) if kinds[k] & SIGN else None
        if rule is not None or not sure:
            rules[k] = rule
    # a space that can't change begins a word whatever was decided before it
    spaced = np.flatnonzero(sp).tolist()
    fixed = [x for x in spaced if x not in rules]
    ends = [*(x + 1 for x in spaced), n]
    put, a, f = sp.copy(), 0, 0
    for k, rule in rules.items():
        while f < len(fixed) and fixed[f] < k:
            a = max(a, fixed[f] + 1)
            f += 1
        now = bool(sp[k])
        if rule is None:
            rule = now
            left, right = core(t[a : k + 1]), core(t[k + 1 : ends[bisect_right(ends, k + 1)]])
            whole = left + right
            if left and right and _HANGUL.search(whole):
                joined = tokens[whole] + tokens[stripped(whole)] - (not now)
                apart = max(pairs[left, right] - now, 0)
                if joined > 0 and apart == 0:
                    rule = False
                elif apart > 0 and joined <= 0:
                    rule = True
        put[k] = rule
        if rule:
            a = k + 1
    changed = int((put != sp).sum())
    if not changed:
        return text, 0
    at = np.flatnonzero(put) + 1
    return "".join([t[x:z] + " " for x, z in zip([0, *at[:-1]], at)]) + t[at[-1] if len(at) else 0 :], changed


def _document(texts: list[str | None], gaps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[str | None, int]]:
    """A document's lines as they should be. Its usual space is that of written ones; few of them give 0.5."""
    if not any(t and _HANGUL.search(t) for t in texts):
        return [(t, 0) for t in texts]
    written = np.concatenate([g[s == MODEL] for _, g, s in gaps])
    written = np.sort(written[~np.isnan(written)])
    word = float(written[len(written) // 2]) if len(written) >= 15 else 0.5
    tokens, pairs = document_words(texts)
    return [_refined(t, *x, word, tokens, pairs) if t and _HANGUL.search(t) else (t, 0) for t, x in zip(texts, gaps)]


def refined_spacing(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, text, n_changed): lines with their spaces as they should be.

    A line of single characters, all apart, three of them Hangul, is one word if its usual gap is narrower than the document's usual space, else as many.
    Other gaps are looked at where signs speak, or what was read is unsure; but a space between Hangul as wide as usual stays. Signs decide; else whether the document has the words on
    both sides as one word alone, or side by side alone, this place left aside; else nothing changes. Gaps are decided from left to right, and
    a word's beginning depends on the decisions before it. Lines whose info doesn't fit their characters, and those without Hangul, stay as they are.

    A document's lines come to one task, one document behind the other, and are worked on as they come: one document is held at a time.
    """
    kind = F.expr(f"transform(info.src, s -> cast(case when s is null then {NONE} when s in ('p', 'gap') then {GUESSED} when s = 'model' then {MODEL} else {OTHER} end as tinyint))") if dict(lines.select("info.src").dtypes)["src"] == "array<string>" else F.col("info.src")
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select(*LINE, "text", F.col("info.p").cast("array<double>").alias("p"), F.col("info.g").cast("array<double>").alias("g"), kind.alias("src")).repartition(n, "doc_id").sortWithinPartitions("doc_id")
    full = StructType([*(lines.schema[c] for c in (*LINE, "text")), StructField("n_changed", IntegerType(), False)])

    def arrays(batch: pa.RecordBatch) -> list[tuple[np.ndarray, ...]]:
        out = []
        for k in (3, 4, 5):
            lists = batch.column(k)
            z = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            out.append([flat[x:y] for x, y in zip([0, *z[:-1]], z)])
        return list(zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(full)

        def done(doc, held):
            texts = [h[1] for h in held]
            new = [(t, 0) for t in texts] if doc is None else _document(texts, [h[2] for h in held])
            return [(doc, h[0], t, c) for h, (t, c) in zip(held, new)]

        doc, held, ready, chars = None, [], [], 0
        for batch in batches:
            for d, at, text, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), arrays(batch)):
                if held and d != doc:
                    ready += done(doc, held)
                    held = []
                    if chars > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), target)], schema=target)
                        ready, chars = [], 0
                doc, chars = d, chars + len(text or "")
                held.append((at, text, x))
        ready += done(doc, held)
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), target)], schema=target)

    return rows.mapInArrow(run, full)
