"""Benchmark decontamination by spaced seeds.

A seed is a hash of some of the words in a short stretch, at the places that a mask names; words at the other places may
differ. The masks are made from the rule below: whatever overlap it accepts holds at least one of them, for items of any
length and substitutions at any places (see `masks`). All seeds of all benchmark items are joined to all seeds of all documents; a bitmap of fixed size,
made of the benchmark's seeds, keeps most other document seeds from being shuffled. Every hit gives an offset between an
item and a document, and along each such offset the longest overlap is taken that keeps a word's agreement worth 1 and a
substitution worth -`penalty`. It counts if it agrees in at least `least` words, or in `share` of an item's words where
that is fewer.

Words are runs of letters and digits in lower case (A-Z), and single code points in scripts that write no spaces between
words (Han, kana, Thai, Lao, Khmer, Myanmar); signs and white space of any script are passed over. Null and empty texts overlap with nothing, and items of under `shortest` words, if that is set, don't either: by the
rule an item of one word is found wherever that word stands.
Repeated rows count as one document or item; rows without an id are left out. Without items or documents there are no rows.
Of overlaps of one pair that agree in as many words, the one with more words counts, then the one further back. Texts of
any length are read whole; other columns of both tables, whatever their names, are left aside. Texts are shuffled only
where a bitmap of the documents with hits lets them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bitmap import bitmap, has_hash, has_id, of_hash, of_id, without
from quire.llm.common import texts, written
from quire.llm.textvec import WORD, Words, code_points, keep, lower_ascii, mix, runs

#: Agreeing words of an overlap's end that masks are made from at most, words of a mask, and stretches that are listed.
DEEP, WEIGHT, LISTED = 10, 6, 2000
OVERLAP = "doc_id long, item_id long, doc_word long, item_word int, n_words int, n_same int"


def _runs(column) -> Iterator[tuple[int, int, Words]]:
    for i, j, w in runs(column, code_points(), lower_ascii()):
        yield i, j, keep(w, w.kinds == WORD)


def stretches(n: int, penalty: float, longest: int) -> list[str] | None:
    """All ends of overlaps, from an agreeing word on, in which n words agree (1) and others don't (0); None if too many.

    best_overlap takes the first end with the highest score, so every end of an overlap scores above 0.
    """
    least = 0.0 if float(penalty * 64).is_integer() else -1e-9  # other sums are rounded, so 0 may turn out above 0
    out, ways = [], [("", 0, 0.0)]
    while ways:
        p, ones, score = ways.pop()
        if ones == n:
            out.append(p[::-1])
        elif len(p) < longest:
            ways.append((p + "1", ones + 1, score + 1))
            if score - penalty > least:
                ways.append((p + "0", ones, score - penalty))
        if len(out) + len(ways) > LISTED:
            return None
    return out


@lru_cache
def masks(n_words: int, least: int, share: float, penalty: float) -> tuple[str, ...]:
    """Masks of which every overlap that counts, with an item of n_words words, holds one.

    An overlap that counts agrees in n words or more, so it has an end in which just n agree: masks are taken, each time
    the one that the most ends hold, until every end holds one. Few misses allowed, or a short item, leave n as it is;
    many make it smaller, down to 1.
    """
    n = min(max(ceil(min(least, share * n_words) - 1e-9), 1), DEEP)
    while (ends := stretches(n, penalty, n_words)) is None:
        n -= 1
    held: dict[tuple, int] = {}
    for i, end in enumerate(ends):
        ones = [k for k, c in enumerate(end) if c == "1"]
        for at in {tuple(k - chosen[0] for k in chosen) for chosen in combinations(ones, min(n, WEIGHT))}:
            held[at] = held.get(at, 0) | 1 << i
    out, left = [], (1 << len(ends)) - 1
    while left:
        best = max(held, key=lambda at: ((held[at] & left).bit_count(), -at[-1], at))
        out.append("".join("01"[k in best] for k in range(best[-1] + 1)))
        left &= ~held[best]
    return tuple(out)


def lengths_of(least: int, share: float, penalty: float, shortest: int) -> dict[str, list[int]]:
    """Each mask's lengths of items; the last length stands for all longer ones too, whose ends are the same."""
    out: dict[str, list[int]] = {}
    last = max(shortest, DEEP + int(DEEP / max(penalty, 0.1)), min(ceil(least / max(share, 0.1)), 1000))
    for n in range(shortest, last + 1):
        for mask in masks(n, least, share, penalty):
            out.setdefault(mask, []).append(n)
    return out


def seeds(w: Words, mask: str, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the mask at each place of each text, or of the chosen texts."""
    n, m = len(mask), len(w.hashes)
    if m < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(m - n + 1, np.uint64(int(mask, 2)))
    for k, one in enumerate(mask):
        if one == "1":
            h = h * np.uint64(0xFF51AFD7ED558CCD) + w.hashes[k : m - n + 1 + k]
            h ^= h >> np.uint64(29)
    at = np.arange(m - n + 1)
    left = np.repeat(w.firsts[1:], w.counts)[: m - n + 1] - at
    ok = left >= n
    if chosen is not None:
        ok &= np.repeat(chosen, w.counts)[: m - n + 1]
    at = at[ok]
    return mix(h[ok] + np.uint64(len(mask) << 8)), at


#: The masks for items of any length, with overlaps' own bounds.
MASKS = (*lengths_of(10, 0.75, 2.0, 1),)


def best_overlap(same: np.ndarray, penalty: float) -> tuple[int, int, int]:
    """(from, to, agreeing words) of the stretch with the highest score, the first of equals."""
    score = np.append(0.0, np.cumsum(np.where(same, 1.0, -penalty)))
    low = np.minimum.accumulate(score)
    to = int(np.argmax(score - low))
    start = int(np.argmin(score[: to + 1]))
    return start, to, int(same[start:to].sum())


def overlaps(docs: DataFrame, items: DataFrame, least: int = 10, share: float = 0.75, penalty: float = 2.0, shortest: int = 1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """OVERLAP: for each document and item that overlap, the overlap that agrees in most words."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).dropna(subset=["doc_id"])
    tests = texts(items, item_col, text_col).withColumnRenamed("doc_id", "item_id").dropna(subset=["item_id"])
    lengths = lengths_of(least, share, penalty, shortest)
    known = list(lengths)
    last = max((n for of in lengths.values() for n in of), default=0)

    def item_seeds(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, w in _runs(batch.column(1)):
                ids = batch.column(0)[i:j].to_numpy()
                for k, mask in enumerate(known):
                    h, at = seeds(w, mask, np.isin(np.minimum(w.counts, last), lengths[mask]))
                    text = w.texts[at]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[text]), pa.array((at - w.firsts[text]).astype(np.int32)), pa.array(np.full(len(at), k, np.int32))], ["seed", "item_id", "item_word", "mask"])

    test_seeds = tests.mapInArrow(item_seeds, "seed long, item_id long, item_word int, mask int").distinct()
    needed = [known[r[0]] for r in test_seeds.select("mask").distinct().orderBy("mask").collect()]
    held = spark.sparkContext.broadcast(bitmap(test_seeds, of_hash("seed")))

    def doc_seeds(batches):
        import pyarrow as pa

        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for i, j, w in _runs(batch.column(1)):
                ids, texts_of = batch.column(0)[i:j].to_numpy(), w.texts
                for mask in needed:
                    h, at = seeds(w, mask)
                    hit = has_hash(bits, h)
                    h, at = h[hit], at[hit]
                    text = texts_of[at]
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[text]), pa.array(at - w.firsts[text])], ["seed", "doc_id", "doc_word"])

    # a seed of few and common words stands in very many documents: their side of the join is the large one, and Spark splits its
    # skewed partitions, giving each part the items' few seeds; what comes out is made distinct before it is shuffled again
    hits = rows.mapInArrow(doc_seeds, "seed long, doc_id long, doc_word long").join(test_seeds, "seed")
    shifts = hits.select("doc_id", "item_id", (F.col("doc_word") - F.col("item_word")).alias("shift")).distinct()
    pairs = written(shifts.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_list("shift")).alias("shifts")), "seed-hits")
    met = spark.sparkContext.broadcast(bitmap(pairs, of_id("doc_id")))

    def met_docs(batches):
        import pyarrow as pa

        bits = np.frombuffer(met.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(has_id(bits, batch.column(0).to_numpy())))

    def verified(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for (_, _, w), (_, _, t), doc, item, shifts in zip(_each(batch.column(2)), _each(batch.column(3)), batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                a, b, best = w.hashes, t.hashes, None
                for s in shifts:
                    first, last = max(0, -s), min(len(b), len(a) - s)
                    if last <= first:
                        continue
                    start, to, n = best_overlap(a[first + s : last + s] == b[first:last], penalty)
                    if n >= min(least, share * len(b)) and (best is None or n > best[5]):
                        best = (doc, item, first + start + s, first + start, to - start, n)
                if best:
                    out.append(best)
            cols = [*zip(*out)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_same"])

    mine = pairs.join(tests.withColumnRenamed("text", "item_text"), "item_id").join(rows.mapInArrow(met_docs, "doc_id long, text string"), "doc_id").select("doc_id", "item_id", "text", "item_text", "shifts")
    found = mine.mapInArrow(verified, OVERLAP)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_same", "n_words", "doc_word", "item_word")).alias("x")).select("doc_id", "item_id", "x.doc_word", "x.item_word", "x.n_words", "x.n_same")


def _each(column) -> Iterator[tuple[int, int, Words]]:
    for i in range(len(column)):
        yield next(_runs(column[i : i + 1]))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, all columns, that overlap with no item. Rows without an id stay."""
    return without(docs, written(overlaps(docs, items, id_col=id_col, **how).select("doc_id"), "leaks"), id_col=id_col)
