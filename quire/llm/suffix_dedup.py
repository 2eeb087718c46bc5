"""Bytes that stand in a string of `length` bytes which also starts elsewhere, by merging sorted runs of suffixes.

What is looked for are windows: `length` bytes in a row of one text's UTF-8. Every window has an anchor, the place of the smallest
hash of its runs of K bytes (of equal ones the leftmost), so equal windows have theirs at the same place, and only suffixes that begin
at an anchor whose run occurs twice or more are sorted. Such a suffix is one record for all windows of its anchor: `length`
bytes from the anchor on, as far as its windows reach, and what these have to the left of it, read backwards.

1. Each task sorts its records into runs and hands on equal ones once: what occurs twice in a run is settled there.
   Runs are cut at the same places everywhere (ranges of suffixes, from a sample of anchors; it decides on the balance
   alone), each suffix as the number of bytes it shares with the one before it, and its rest.
2. The runs of a range are merged by a loser tree whose players know how much they share with the last winner. Players that share
   unlike lengths are told apart by these; only those that share as much are compared, from there on. So the merged
   suffixes come with their common prefixes.
3. A window that begins j bytes before its anchor is equal to another one if both share length - j bytes from their anchors on,
   which neighbours' common prefixes tell, and j bytes backwards, which the sorted left sides tell.

A run of K bytes that many windows have is split where it stands: its windows go by their distance to the anchor into
records of `NARROW` windows or one, which share more bytes, and so are sorted apart. Memory per task doesn't grow with the corpus; driver and tasks
know up to SPLITTERS places where ranges begin. Texts are read twice: for their anchors, and to make records of them, equal
texts once; those with anything removed a third time for the checksum.

Matches never cross texts. Null texts are empty; texts of fewer than `length` bytes lose nothing. Equal rows count as
places of their own, so each of two equal texts of `length` bytes or more is removed whole. Rows are known by two 64-bit hashes of
their text, and give a row each, whatever their doc_id, null included. Other columns of docs, whatever their names, are
left aside; no documents, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bitmap import bitmap, has_hash, of_hash
from quire.llm.common import texts, tidy, written
from quire.llm.textvec import mix

K = 64
#: Anchors whose run of K bytes occurs more often than this are split into records of NARROW windows, or of one.
HOT, HOTTEST, NARROW = 1 << 12, 1 << 20, 18
CHUNK = 1 << 20  # bytes looked at at once
RUN = 1 << 15  # records of a run
RANGE = 1 << 16  # records that a range should have
SPLITTERS = 1 << 16
_U = np.uint64
_PLACE = _U((1 << 24) - 1)
_SPREAD = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=_U)) | _U(1)


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on."""
    h, size, power = _BYTES[data], 1, _SPREAD
    while size < K:
        h = h[:-size] * _U(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 64)
    return mix(h)


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each place on."""
    size = 1
    while 2 * size <= w:
        v, size = np.minimum(v[:-size], v[size:]), 2 * size
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple]:
    """(hash, text, anchor, least and most windows' distance to it) of all windows in texts that stand one behind another."""
    sizes = np.diff(bounds)
    for c in range(int(bounds[0]), int(bounds[-1]) - length + 1, CHUNK):
        piece = data[c : c + CHUNK + length - 1]
        h = _hashes(piece)
        at = (_least((h & ~_PLACE) | np.arange(len(h), dtype=_U), length - K + 1) & _PLACE).astype(np.int64)
        ends = np.zeros(len(at) + 1, np.int64)
        long = np.flatnonzero((sizes >= length) & (bounds[:-1] < c + len(at)) & (bounds[1:] - length >= c))
        np.add.at(ends, np.maximum(bounds[long] - c, 0), 1)
        np.add.at(ends, np.minimum(bounds[long + 1] - length + 1 - c, len(at)), -1)
        start = np.flatnonzero(np.cumsum(ends[:-1]) > 0)
        if not len(start):
            continue
        at, text = at[start], np.searchsorted(bounds, start + c, "right") - 1
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
        last = np.append(first[1:], len(start)) - 1
        a = at[first]
        yield mix(h[a] + _U(_SPREAD)), text[first], a + c, a - start[last], a - start[first]


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text begins) of an Arrow string or binary column."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def anchored(rows: DataFrame, length: int) -> DataFrame:
    """(hash, d1, d2, place, head): anchors of all texts; place: anchor << 16, then the windows' least and most distance;
    head: the first 8 bytes, of one anchor in 64."""

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, bounds = _bytes_of(batch.column(2))
            d1, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            with np.errstate(over="ignore"):
                for h, text, a, near, far in anchors(data, bounds, length):
                    head = _heads(data, a)
                    place = (a - bounds[text]) << 16 | near << 8 | far
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d1[text]), pa.array(d2[text]), pa.array(place), pa.array(head, mask=h & _U(63) != 0)], ["hash", "d1", "d2", "place", "head"])
        tidy()

    return rows.select("d1", "d2", "text").mapInArrow(found, "hash long, d1 long, d2 long, place long, head long")


def _heads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as numbers in the bytes' order."""
    return _ordered(data[at[:, None] + np.arange(8)])


def _ordered(first: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(first).view(">u8")[:, 0].astype(_U) ^ _U(1 << 63)).view(np.int64)


class Records:
    """Suffixes at anchors, with their left sides: rows of `length` bytes, then `left` bytes backwards, filled with zeros."""

    def __init__(self, length: int, bytes_, near, far, d1, d2, at, step):
        self.length, self.bytes, self.near, self.far, self.d1, self.d2, self.at, self.step = length, bytes_, near, far, d1, d2, at, step

    def take(self, which) -> Records:
        return Records(self.length, *(x[which] for x in (self.bytes, self.near, self.far, self.d1, self.d2, self.at, self.step)))

    def __len__(self) -> int:
        return len(self.at)

    @staticmethod
    def joined(many: list[Records]) -> Records:
        return Records(many[0].length, *(np.concatenate([getattr(m, x) for m in many]) for x in ("bytes", "near", "far", "d1", "d2", "at", "step")))


def _cut(data: np.ndarray, first: int, at, near, far, d1: int, d2: int, step, length: int) -> Records:
    """Records of one text, which begins at `first`. at: anchors in the text, -1 - at for those that need no answer."""
    place = np.where(at < 0, -1 - at, at) + first
    left = length - K
    right_at = place[:, None] + np.arange(length)
    right = np.where(np.arange(length) < length - near[:, None], data[np.minimum(right_at, len(data) - 1)], 0)
    left_at = place[:, None] - 1 - np.arange(left)
    behind = np.where(np.arange(left) < far[:, None], data[np.maximum(left_at, 0)], 0)
    return Records(length, np.concatenate([right, behind], 1).astype(np.uint8), near, far, np.full(len(at), d1), np.full(len(at), d2), at, step)


def _collapsed(r: Records) -> tuple[Records, np.ndarray]:
    """(the records sorted, equal ones once, these without asking for an answer; which of r are equal to others)."""
    whole = np.concatenate([r.bytes, r.near[:, None].astype(np.uint8), r.far[:, None].astype(np.uint8), (r.step[:, None] & 255).astype(np.uint8), np.ones((len(r), 1), np.uint8)], 1)
    order = np.argsort(np.ascontiguousarray(whole).view(f"S{whole.shape[1]}")[:, 0], kind="stable")
    whole = whole[order]
    new = np.append(True, (whole[1:] != whole[:-1]).any(1))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(r)))
    open_ = np.add.reduceat(r.at[order] >= 0, first)  # how many of each ask for an answer
    out = r.take(order[first])
    settled = (size > 1) | (open_ == 0)
    out.at = np.where(settled & (out.at >= 0), -1 - out.at, out.at)
    known = np.zeros(len(r), bool)
    known[order] = np.repeat(size > 1, size)
    return out, known & (r.at >= 0)


def _narrowed(r: Records) -> Iterator[Records]:
    """Records of frequent anchors as several ones, of `step` windows each."""
    length = r.length
    for step in np.unique(r.step):
        of = r.take(r.step == step)
        for base in range(0, length - K + 1, int(step)):
            some = of.take((of.far >= base) & (of.near < base + step))
            if not len(some):
                continue
            near, far = np.maximum(some.near - base, 0), np.minimum(some.far - base, step - 1)
            # `base` bytes of the left side go to the right one
            right = np.concatenate([some.bytes[:, length : length + base][:, ::-1], some.bytes[:, : length - base]], 1)
            left = np.zeros((len(some), length - K), np.uint8)
            left[:, : length - K - base] = some.bytes[:, length + base :]
            right[np.arange(length) >= (length - near)[:, None]] = 0
            left[np.arange(length - K) >= far[:, None]] = 0
            at = np.where(some.at < 0, some.at + base, some.at - base)
            yield Records(length, np.concatenate([right, left], 1), near, far, some.d1, some.d2, at, np.full(len(some), length))


def shared(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before it; 0 for the first."""
    differ = rows[1:] != rows[:-1]
    return np.append(0, np.where(differ.any(1), differ.argmax(1), rows.shape[1])) if len(rows) else np.zeros(0, np.int64)


def front_coded(r: Records) -> bytes:
    """A sorted run: lengths shared with the suffix before, windows, owners, then rests and left sides."""
    n, length = len(r), r.length
    common = shared(r.bytes[:, :length])
    wanted = np.concatenate([np.arange(length) >= common[:, None], np.arange(length - K) < r.far[:, None]], 1)
    owners = np.stack([r.d1, r.d2, r.at], 1)
    return b"".join([n.to_bytes(4, "little"), *(x.astype("<i2").tobytes() for x in (common, r.near, r.far)), owners.astype("<i8").tobytes(), r.bytes[wanted].tobytes()])


class Run:
    """A front-coded run, read."""

    def __init__(self, coded: bytes, length: int):
        n = int.from_bytes(coded[:4], "little")
        self.common, self.near, self.far = np.frombuffer(coded, "<i2", 3 * n, 4).reshape(3, n).astype(np.int64)
        self.owners = np.frombuffer(coded, "<i8", 3 * n, 4 + 6 * n).reshape(n, 3)
        rest = coded[4 + 30 * n :]
        cuts = np.append(0, np.cumsum(length - self.common + self.far)).tolist()
        self.suffixes, self.left, before = [], np.zeros((n, length - K), np.uint8), b""
        for i, (c, f) in enumerate(zip(self.common.tolist(), self.far.tolist())):
            cut = cuts[i] + length - c
            before = before[:c] + rest[cuts[i] : cut]
            self.suffixes.append(before)
            if f:
                self.left[i, :f] = np.frombuffer(rest, np.uint8, f, cut)
        self.lcps = self.common.tolist()


def merged(runs: list[Run], length: int) -> tuple[list[int], list[int], list[int]]:
    """(run, place in it, bytes shared with the one before) of all suffixes in their order, by a loser tree.

    Each player's `h` is how much it shares with the last winner; -1 when its run is over. Of two players the one that shares more
    comes first, as it goes on like the last winner where the other one already stands above it.
    """
    size = 1
    while size < len(runs):
        size *= 2
    h = [0] * len(runs) + [-1] * (size - len(runs))
    heads = [r.suffixes[0] for r in runs] + [b""] * (size - len(runs))
    ends, at = [len(r.suffixes) for r in runs], [0] * len(runs)

    def beaten(a: int, b: int, from_: int) -> tuple[int, int]:
        """(winner, loser) of players that share as much with the last winner; the loser knows what it shares with this one."""
        x, y = heads[a], heads[b]
        differ = int.from_bytes(x[from_:], "big") ^ int.from_bytes(y[from_:], "big")
        same = length - (differ.bit_length() + 7) // 8
        if differ and y[same] < x[same]:
            a, b = b, a
        h[b] = same
        return a, b

    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if h[a] == h[b]:
            if h[a] >= 0:
                a, b = beaten(a, b, h[a])
        elif h[a] < h[b]:
            a, b = b, a
        winners[node], losers[node] = a, b
    who, where, common = [], [], []
    w = winners[1]
    for _ in range(sum(ends)):
        i = at[w]
        who.append(w)
        where.append(i)
        common.append(h[w])
        i += 1
        at[w] = i
        if i == ends[w]:
            h[w] = -1
        else:
            heads[w], h[w] = runs[w].suffixes[i], runs[w].lcps[i]
        node = (w + size) >> 1
        while node:
            o = losers[node]
            if h[o] > h[w]:
                losers[node], w = w, o
            elif h[o] == h[w] >= 0:
                w, losers[node] = beaten(w, o, h[w])
            node >>= 1
    return who, where, common


def repeated(common: np.ndarray, near: np.ndarray, far: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Which windows (by their distance to the anchor) of merged suffixes are equal to another one's."""
    n = len(common)
    out = np.zeros((n, length - K + 1), bool)
    order = np.argsort(np.ascontiguousarray(np.concatenate([left, np.ones((n, 1), np.uint8)], 1)).view(f"S{left.shape[1] + 1}")[:, 0], kind="stable")
    behind = shared(left[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    most = np.maximum(common, np.append(common[1:], 0))  # shared with either neighbour
    for j in range(length - K + 1):
        some = np.flatnonzero((near <= j) & (j <= far) & (most >= length - j))
        if len(some) < 2:
            continue
        right_of = np.cumsum(common < length - j)[some]
        left_of = np.cumsum(behind < j)[rank[some]]
        both = right_of * (n + 1) + left_of
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        twice = np.append(False, same) | np.append(same, False)
        out[some[by[twice]], j] = True
    return out


SPANS = "d1 long, d2 long, first long, last long"


def _spans(d1, d2, first, last):
    import pyarrow as pa

    return [pa.array(np.asarray(x, np.int64)) for x in (d1, d2, first, last)]


def runs(texts_: DataFrame, splitters: np.ndarray, dealt: int, length: int) -> DataFrame:
    """Two kinds of rows: (part, run) of sorted runs, and the spans that tasks have settled by themselves.

    texts_: d1, d2, text, copies, places; a text with copies is settled whole. Each range is dealt on to `dealt` parts by
    its first K bytes.
    """
    held = texts_.sparkSession.sparkContext.broadcast(splitters)

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["part", "run", "d1", "d2", "first", "last"]

        def spans(d1, d2, first, last):
            n = len(d1)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *_spans(d1, d2, first, last)], names)

        def settled(r: Records, known):
            return spans(r.d1[known], r.d2[known], r.at[known] - r.far[known], r.at[known] - r.near[known] + length)

        def parts(r: Records) -> Iterator:
            part = np.searchsorted(held.value, _ordered(r.bytes[:, :8]), "right")
            if dealt > 1:
                h = np.zeros(len(r), _U)
                for c in range(K):
                    h = h * _U(_SPREAD) + _BYTES[r.bytes[:, c]]
                part = part * dealt + (mix(h) % _U(dealt)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)).tolist() + [len(r)]
            coded = [front_coded(r.take(order[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
            n = len(coded)
            yield pa.RecordBatch.from_arrays([pa.array(part[order[cuts[:-1]]].astype(np.int64)), pa.array(coded, pa.binary()), *[pa.nulls(n, pa.int64())] * 4], names)

        def flush(waiting: list[Records]) -> Iterator:
            every = Records.joined(waiting)
            for i in range(0, len(every), RUN):
                r = every.take(slice(i, i + RUN))
                kept, known = _collapsed(r)
                yield settled(r, known)
                wide = kept.take(kept.step >= length)
                if len(wide):
                    yield from parts(wide)
                for some in _narrowed(kept.take(kept.step < length)):
                    kept_, known = _collapsed(some)
                    yield settled(some, known)
                    yield from parts(kept_)

        waiting, size = [], 0
        for batch in batches:
            data, bounds = _bytes_of(batch.column(2))
            offsets, items = np.asarray(batch.column(4).offsets), batch.column(4).values
            places, steps = items.field(0).to_numpy(), items.field(1).to_numpy()
            whole: list[tuple] = []
            for t, (d1, d2, copies) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                if copies > 1:
                    whole.append((d1, d2, 0, bounds[t + 1] - bounds[t]))
                for i in range(offsets[t], offsets[t + 1], RUN):
                    place, step = places[i : min(i + RUN, offsets[t + 1])], steps[i : min(i + RUN, offsets[t + 1])].astype(np.int64)
                    at = place >> 16
                    waiting.append(_cut(data, int(bounds[t]), -1 - at if copies > 1 else at, place >> 8 & 255, place & 255, d1, d2, step, length))
                    size += len(place)
                    if size >= RUN:
                        yield from flush(waiting)
                        waiting, size = [], 0
            if whole:
                yield spans(*zip(*whole))
        if waiting:
            yield from flush(waiting)
        tidy()

    return texts_.mapInArrow(of, f"part long, run binary, {SPANS}")


def merged_spans(runs_: DataFrame, length: int) -> DataFrame:
    """The spans of bytes that windows cover which merged runs show to be equal to others."""

    def spans(coded: list[bytes]):
        import pyarrow as pa

        read = [Run(c, length) for c in coded]
        who, where, common = merged(read, length)
        starts = np.append(0, np.cumsum([len(r.suffixes) for r in read]))
        at = starts[np.array(who)] + np.array(where)
        common = np.array(common)
        all_ = lambda x: np.concatenate([getattr(r, x) for r in read])[at]
        alike = np.maximum(common, np.append(common[1:], 0)) >= K
        near, far, left, owners = (all_(x)[alike] for x in ("near", "far", "left", "owners"))
        # those left out share fewer than K bytes with their neighbours: what others share across them is less, too
        kept = np.flatnonzero(alike)
        common = np.minimum.reduceat(common[: kept[-1] + 1], np.append(0, kept[:-1] + 1)) if len(kept) else common[:0]
        equal = repeated(common, near, far, left, length) & (owners[:, 2:] >= 0)
        edges = np.diff(np.pad(equal, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)
        return pa.RecordBatch.from_arrays(_spans(owners[row, 0], owners[row, 1], owners[row, 2] - high + 1, owners[row, 2] - low + length), ["d1", "d2", "first", "last"])

    def of(batches: Iterator) -> Iterator:
        part, coded = None, []
        for batch in batches:
            for p, run in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part and coded:
                    yield spans(coded)
                    coded = []
                part = p
                coded.append(run.as_py())
        if coded:
            yield spans(coded)
        tidy()

    return runs_.mapInArrow(of, SPANS)


def _kept(texts_: DataFrame) -> DataFrame:
    """(d1, d2, n_removed, n_spans, kept_sha256) of texts with spans."""

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, bounds = _bytes_of(batch.column(2))
            offsets, items = np.asarray(batch.column(3).offsets), batch.column(3).values
            first, last = items.field(0).to_numpy(), items.field(1).to_numpy()
            out = []
            for t in range(batch.num_rows):
                a, b = first[offsets[t] : offsets[t + 1]], last[offsets[t] : offsets[t + 1]]
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                opens = np.append(True, a[1:] > b[:-1])  # runs that touch are one
                a, b = a[opens], b[np.append(opens[1:], True)]
                text = data[bounds[t] : bounds[t + 1]]
                rest = hashlib.sha256()
                for x, y in zip(np.append(0, b), np.append(a, len(text))):
                    rest.update(text[x:y])
                out.append((int((b - a).sum()), len(a), rest.hexdigest()))
            removed, spans, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["d1", "d2", "n_removed", "n_spans", "kept_sha256"])

    return texts_.mapInArrow(of, "d1 long, d2 long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs. length: more than K, less than K + 256 bytes."""
    if not K < length < K + 256:
        raise ValueError(f"length must be between {K + 1} and {K + 255}")
    rows = texts(docs, id_col, text_col).withColumns({"d1": F.xxhash64(F.lit(1), "text"), "d2": F.xxhash64(F.lit(2), "text")})
    long = rows.filter(F.octet_length("text") >= length)
    found = written(anchored(long, length), "anchors")
    twice = written(found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-anchors")
    records = twice.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, records // RANGE)
    some = min(ranges, SPLITTERS)
    cuts = found.agg(F.percentile_approx("head", [i / some for i in range(1, some)], max(10_000, 10 * some)).alias("cuts")).first().cuts if some > 1 else None
    bits = found.sparkSession.sparkContext.broadcast(bitmap(twice, of_hash("hash")))

    def maybe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(has_hash(known, batch.column(0).to_numpy())))

    step = F.when(F.col("n") <= HOT, length).when(F.col("n") <= HOTTEST, NARROW).otherwise(1)
    again = found.select("hash", "d1", "d2", "place").mapInArrow(maybe, "hash long, d1 long, d2 long, place long").join(twice, "hash")
    places = again.groupBy("d1", "d2").agg(F.collect_set(F.struct("place", step.cast("int").alias("step"))).alias("places"))
    whole = long.groupBy("d1", "d2").agg(F.first("text").alias("text"), F.count("*").alias("copies")).join(places, ["d1", "d2"])
    made = written(runs(whole.select("d1", "d2", "text", "copies", "places"), np.array(cuts or [], np.int64), -(-ranges // SPLITTERS), length), "suffix-runs")

    parts = made.filter("part is not null").select("part", "run").repartition(max(1, ranges // 2), "part").sortWithinPartitions("part")
    settled = made.filter("part is null").select("d1", "d2", "first", "last")
    spans = settled.unionByName(merged_spans(parts, length)).groupBy("d1", "d2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = written(spans, "repeated-spans")

    hit = found.sparkSession.sparkContext.broadcast(bitmap(spans, of_hash("d1")))

    def touched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = np.frombuffer(hit.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(has_hash(known, batch.column(0).to_numpy())))

    some_texts = long.select("d1", "d2", "text").mapInArrow(touched, "d1 long, d2 long, text string")
    some_texts = some_texts.groupBy("d1", "d2").agg(F.first("text").alias("text")).join(spans, ["d1", "d2"])
    less = written(_kept(some_texts.select("d1", "d2", "text", "spans")), "kept-texts")
    whole_sha = F.sha2(F.encode("text", "UTF-8"), 256)
    small = rows.select("doc_id", "d1", "d2", F.octet_length("text").cast("long").alias("n_bytes"), whole_sha.alias("whole_sha256"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return small.join(less, ["d1", "d2"], "left").select("doc_id", "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
