"""Exact n-gram Jaccard self-join of documents by adaptive multi-match prefixes.

A document's set holds its distinct runs of `n` words; with fewer words, all of them as one. Two documents link when
100 * |A and B| >= `percent` * |A or B|; the result is each document's component, the smallest doc_id that links reach.

Sets are ordered alike everywhere: by how far a shingle's cell of 2^CELLS stands above the usual count over all documents,
then by hash, so that common passages come last. If A and B link, each shares at least a known number of shingles with the other, so with a prefix
that leaves out all but l - 1 of those, they share at least l prefix shingles. Every document chooses its own l: with
the estimated lists behind its prefix shingles, a longer prefix costs their scan, and saves candidates, which must
match l times instead of once. Of a pair, the smaller l counts, and only shingles in the prefixes that l and both sizes
leave: sets of like sizes must share six in seven, so their prefixes are shorter, and what these spare goes into more
matches (`_match`).

Documents with equal sets are one class, known by a 64-bit and a 56-bit digest and the set's size. Shingles that only
one class has in its prefix are dropped in the shuffle that brings them together. What is left is joined in two steps:

1. Stars: within each shingle's list every class is paired with the list's pivot alone, each class keeps the pivot it
   shares most shingles with, and these pairs are verified. So a group of many near copies becomes one component with
   as many verifications as it has members. This is done `stars` times, with other pivots.
2. The rest, exactly: within each list only classes of different components are paired, those pairs that match often
   enough are verified, and links between components merge these. No pair is left out, whatever the lists' lengths.

Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case. Null and empty texts, and those of white space alone,
have an empty set: they link with nothing, and are their own component. Rows with the same id are one node, and each
gives a row; a row without an id links with nothing and has no component. No documents, no rows. Texts of any length are
worked on whole, each as a run of its own; a similarity of just `percent` links. Other columns of docs, whatever their
names, are left aside, or kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bitmap import bitmap, has_id, of_id, without
from quire.llm.common import texts, written
from quire.llm.components import merged
from quire.llm.textvec import Words, grams, lower_ascii, mix, runs, words_only

CELLS = 22
#: Share of the smaller set by which pairs must match more often than their levels ask for, as far as prefixes reach.
MORE = 0.03
BLOCK = 1 << 15
LEVELS = (1, 2, 4, 8)
#: What the codes of list lengths stand for: 0, then 1 and a tenth more with each.
COSTS = np.append(0.0, 1.1 ** np.arange(255))
_U = np.uint64


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each text's distinct shingles, by text and hash."""
    h, at = grams(w, n)
    text = w.texts[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(few):
        whole = []
        for t in few:
            x = _U(w.counts[t])
            for word in w.hashes[w.firsts[t] : w.firsts[t + 1]]:
                x = mix(np.array([x * _U(0xC4CEB9FE1A85EC53) + word]))[0]
            whole.append(x)
        h, text = np.append(h, np.array(whole, _U)), np.append(text, few)
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    cut = np.searchsorted(text, np.arange(len(w.counts) + 1))
    for a, b in zip(cut[:-1], cut[1:]):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def sets(batches: Iterator, n: int) -> Iterator[tuple]:
    """(batch, from, to, hashes, where each text's hashes begin) for runs of texts."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, j, w in runs(batch.column(1), words_only(), lower_ascii()):
                h, text = shingles(w, n)
                yield batch, i, j, h, np.searchsorted(text, np.arange(j - i + 1))


def least_of(n, percent: int = 75):
    """How many of n shingles a partner must have at least: ceil(n * percent / 100)."""
    return (n * percent + 99) // 100


def surveyed(rows: DataFrame, n: int) -> DataFrame:
    """Two kinds of rows: (doc_id, n_shingles, d1, d2) of each document, and (block, counts) of each task's cells."""

    def survey(batches):
        import pyarrow as pa

        seen, held, size_held = np.zeros(1 << CELLS, np.int64), [], 0
        for batch, i, j, h, cut in sets(batches, n):
            size = np.diff(cut)
            ends = lambda x: np.diff(np.append(_U(0), np.cumsum(x, dtype=_U))[cut])
            d1, d2 = ends(mix(h + _U(1))), ends(mix(h + _U(2)))
            held.append((h >> _U(64 - CELLS)).astype(np.uint32))
            size_held += len(h)
            if size_held > 1 << CELLS - 2:
                seen += np.bincount(np.concatenate(held), minlength=1 << CELLS)
                held, size_held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(size), pa.array(d1.view(np.int64)), pa.array((d2 >> _U(8)).view(np.int64)), pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.binary()), pa.array(np.ones(j - i, bool))], names)
        if held:
            seen += np.bincount(np.concatenate(held), minlength=1 << CELLS)
        if seen.any():
            counts = np.minimum(seen, 65535).astype("<u2").reshape(-1, BLOCK)
            none = pa.nulls(len(counts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(np.arange(len(counts))), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(np.zeros(len(counts), bool))], names)

    names = ["doc_id", "n_shingles", "d1", "d2", "block", "counts", "is_doc"]
    return written(rows.mapInArrow(survey, "doc_id long, n_shingles long, d1 long, d2 long, block long, counts binary, is_doc boolean"), "shingle-survey")


def list_lengths(survey: DataFrame) -> np.ndarray:
    """For each cell of shingles a code of how far it is above the usual count; 0 within what chance makes of it.

    Tasks' counts are added up block by block, and coded where they are added: COSTS says what a code stands for, in steps
    of a tenth. 2^CELLS bytes come to the driver, however large the corpus.
    """
    shingles = survey.filter("is_doc").agg(F.sum("n_shingles")).first()[0] or 0
    usual = shingles / (1 << CELLS)

    def added(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, "<u2").astype(np.int64)
        codes = [np.where(s > usual + 3 * np.sqrt(usual) + 3, np.searchsorted(COSTS[1:], np.maximum(s - usual, 1), "right").clip(1, 255), 0).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int64()), pa.array(codes, pa.binary())], ["block", "codes"])

    got = survey.filter("not is_doc").select("block", "counts").repartition("block").mapInArrow(added, "block long, codes binary").toArrow()
    out = np.zeros(((1 << CELLS) // BLOCK, BLOCK), np.uint8)
    for block, codes in zip(got.column("block"), got.column("codes")):
        out[block.as_py()] = np.frombuffer(codes.as_buffer(), np.uint8)
    return out.reshape(-1)


def level(costs: np.ndarray, n: int, percent: int, scan: float, verify: float) -> int:
    """The l of LEVELS with the least estimated cost; costs: of each shingle's list, in the set's order."""
    base = n - int(least_of(n, percent))
    best, chosen = np.inf, 1
    for l in LEVELS:
        if base + l > n:
            break
        lists = float(costs[: base + l].sum())
        cost = scan * (lists + l) + verify * lists / l
        if cost < best:
            best, chosen = cost, l
    return chosen


def prefixes(rows: DataFrame, n: int, percent: int, often: np.ndarray, scan: float = 1.0, verify: float = 20.0) -> DataFrame:
    """(token, d1, d2, n_shingles, level, rank) of every document's prefix shingles; rank: their place in its order, from 0."""
    held = rows.sparkSession.sparkContext.broadcast(often)

    def prefix(batches):
        import pyarrow as pa

        lists = held.value
        for _, i, j, h, cut in sets(batches, n):
            ends = lambda x: np.diff(np.append(_U(0), np.cumsum(x, dtype=_U))[cut])
            d1, d2 = ends(mix(h + _U(1))).view(np.int64), (ends(mix(h + _U(2))) >> _U(8)).view(np.int64)
            code = lists[h >> _U(64 - CELLS)]
            tokens, which, levels, ranks = [], [], [], []
            for t in range(j - i):
                a, b = cut[t], cut[t + 1]
                size = int(b - a)
                if not size:
                    continue
                x, c, l = h[a:b], code[a:b], 1
                if c.any():
                    order = np.argsort(c, kind="stable")
                    x, c = x[order], c[order]
                    l = level(COSTS[c], size, percent, scan, verify)
                base = size - int(least_of(size, percent))
                tokens.append(x[: base + l])
                which.append(np.full(base + l, t))
                levels.append(np.full(base + l, l, np.int8))
                ranks.append(np.arange(base + l, dtype=np.int32))
            if tokens:
                which = np.concatenate(which)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(d1[which]), pa.array(d2[which]), pa.array(np.diff(cut)[which].astype(np.int32)), pa.array(np.concatenate(levels)), pa.array(np.concatenate(ranks))], ["token", "d1", "d2", "n_shingles", "level", "rank"])

    return rows.mapInArrow(prefix, "token long, d1 long, d2 long, n_shingles int, level byte, rank int")


def in_several(prefixes: DataFrame) -> DataFrame:
    """The rows of prefixes whose token is in the prefixes of several classes.

    Rows come sorted by their token and are looked at as they pass. Of a token that one class alone has had so far, one
    row is held until another class comes, so memory is constant, however long a list is.
    """

    def several(batches):
        import pyarrow as pa

        held, listed = None, None  # the last token's only class so far; the last token, once it has several
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            token, *kind = (batch.column(i).to_numpy() for i in range(4))
            opens = np.append(True, token[1:] != token[:-1])
            first = np.flatnonzero(opens)
            group = np.cumsum(opens) - 1
            other = np.zeros(len(token), bool)
            same = ~opens  # as the row before
            for x in kind:
                other |= x != x[first][group]
                same[1:] &= x[1:] == x[:-1]
            good = np.logical_or.reduceat(other, first)
            good[0] |= listed is not None and token[0] == listed
            listed = token[-1] if good[-1] else None
            held = None if good[-1] else batch.slice(first[-1], 1)
            yield batch.filter(pa.array(good[group] & ~same))

    return prefixes.repartition("token").sortWithinPartitions("token").mapInArrow(several, prefixes.schema)


def class_sets(rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, hashes) of the documents that nodes name; a bitmap keeps most others from being worked on and shuffled."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap(nodes, of_id("node")))

    def kept(batches):
        import pyarrow as pa

        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(has_id(bits, batch.column(0).to_numpy())))

    def hashed(batches):
        import pyarrow as pa

        for batch, i, j, h, cut in sets(batches, n):
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["node", "hashes"])

    some = rows.mapInArrow(kept, "doc_id long, text string").join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    return written(some.dropDuplicates(["doc_id"]).mapInArrow(hashed, "node long, hashes binary"), "shingle-sets")


def linked(rows: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The (a, b) of pairs whose sets are alike enough. Only the pairs' own documents are read for their sets."""
    pairs = written(pairs, "pairs")
    known = class_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), n)

    def verified(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(known.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a").join(known.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(verified, "a long, b long")


def similar_sizes(x: str, y: str, percent: int):
    small, large = F.least(x, y), F.greatest(x, y)
    return small * 100 >= large * percent


def duplicate_components(docs: DataFrame, n: int = 5, percent: int = 75, stars: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    rows = texts(docs, id_col, text_col)
    survey = surveyed(rows, n)
    mine = survey.filter("is_doc").select("doc_id", "n_shingles", "d1", "d2")
    often = list_lengths(survey)

    whole = rows.dropna(subset=["doc_id"])
    same = ["d1", "d2", "n_shingles"]
    shared = in_several(prefixes(whole, n, percent, often))
    classes = mine.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("node")).dropna(subset=["node"])
    lists = written(shared.distinct().join(classes, same).select("token", "node", F.col("n_shingles").cast("int").alias("n_shingles"), "level", "rank"), "shingle-lists")

    labels = None
    for turn in range(stars):
        labels = merged(labels, written(linked(whole, _stars(lists, labels, turn, percent), n, percent), "star-links"))
    labels = merged(labels, written(linked(whole, _rest(lists, labels, percent), n, percent), "links"))

    named = classes.join(labels, "node", "left").select(*same, F.coalesce("label", "node").alias("component_id"))
    out = mine.filter("n_shingles > 0").join(named, same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.unionByName(mine.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, all columns, that have their component's smallest id, one row for each id. Rows without an id stay."""
    found = written(duplicate_components(docs, id_col=id_col, **how).select("doc_id", "component_id"), "components")
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return without(docs, found.filter("doc_id <> component_id"), once=twice, id_col=id_col)


def _with_components(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists with each class's component, without lists that lie in one component."""
    if labels is None:
        return lists.withColumn("component", F.col("node"))
    got = lists.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")
    mixed = got.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return got.join(mixed.select("token"), "token", "left_semi")


def _match(n: str, m: str, one: str, two: str, percent: int):
    """(how often sets of n and m shingles must match in their prefixes for that, what these prefixes leave in front).

    To link, they must share at least `least` shingles. So of the first n - least + l and m - least + l, they share l or
    more, for every l; it is the smaller of both levels, and MORE of the smaller set on top if both prefixes reach so far.
    """
    n, m = F.col(n).cast("long"), F.col(m).cast("long")
    least = F.floor(((n + m) * percent + 99 + percent) / (100 + percent))
    room = lambda x: least - F.floor((x * percent + 99) / 100)
    times = F.least(one, two) + F.greatest(F.least(F.floor(F.least(n, m) * MORE), room(n), room(m)), F.lit(0))
    return times, n - least + times, m - least + times


def _stars(lists: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """(a, b): each class with the one pivot that it shares most lists with, where these lists alone are enough to link.

    A list's pivot is its smallest id at first, then another one by a hash.
    """
    got = _with_components(lists, labels)
    order = (F.col("node") if not turn else F.xxhash64("node", F.lit(turn))).alias("order")
    pivots = got.groupBy("token").agg(F.min(F.struct(order, "node", "n_shingles", "component", "level", "rank")).alias("p"))
    pivots = pivots.select("token", *(F.col(f"p.{c}").alias(f"{c}_b") for c in ("node", "n_shingles", "component", "level", "rank")))
    times, first, second = _match("n_shingles", "n_shingles_b", "level", "level_b", percent)
    near = got.join(pivots, "token").filter((F.col("component") != F.col("component_b")) & similar_sizes("n_shingles", "n_shingles_b", percent) & (F.col("rank") < first) & (F.col("rank_b") < second))
    votes = near.groupBy(F.col("node").alias("a"), F.col("node_b").alias("b"), times.alias("times")).agg(F.count("*").alias("shared"))
    return votes.filter("shared >= times").groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _rest(lists: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """(a, b): all pairs of different components that match as often as their levels and sizes ask for.

    A pair that matches `times` times within the first n - least + times of its shingles has the first of these matches
    within the first n - least + 1. So only these meet in the join, which keeps a group's members apart that have too many
    shingles of their own in front; the pairs' longer prefixes are then compared before any set is.
    """
    got = written(_with_components(lists, labels), "mixed-lists")
    side = lambda s: got.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n_shingles", "level", "rank", "component")))
    times, first, second = _match("n_shingles_a", "n_shingles_b", "level_a", "level_b", percent)
    near = (F.col("component_a") < F.col("component_b")) & similar_sizes("n_shingles_a", "n_shingles_b", percent) & (F.col("rank_a") <= first - times) & (F.col("rank_b") <= second - times)
    met = side("a").join(side("b"), "token").filter(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), times.alias("times"), first.alias("first"), second.alias("second")).distinct()
    mine = got.select(F.col("node").alias("a"), "token", F.col("rank").alias("rank_a"))
    yours = got.select(F.col("node").alias("b"), "token", F.col("rank").alias("rank_b"))
    both = met.join(mine, "a").filter(F.col("rank_a") < F.col("first")).join(yours, ["b", "token"]).filter(F.col("rank_b") < F.col("second"))
    return both.groupBy("a", "b", "times").agg(F.count("*").alias("shared")).filter("shared >= times").select("a", "b")
