"""Product codes of vectors: Lloyd's rounds with Hamerly's bounds, one pair of bounds for each part, in whole numbers.

Every component becomes floor(scale * x); vectors are cut into `parts` equal consecutive parts, each with a codebook that
starts as that part of the `entries` smallest ids. A round assigns every part to its codebook's nearest entry (squared
Euclidean distance, of equal ones the lower index) and then replaces each entry by the componentwise floor of its parts'
mean; entries without parts stay. After `rounds` rounds parts are assigned once more.

With its place in the codebook each part keeps an upper bound of its distance to that entry and a lower bound of its
distance to all others, written with the rows after each assignment. When entries move, the bounds give way by as much. A
part whose upper bound is strictly below its lower one, or below half the way from its entry to the next one, stays where it is;
else its distance is worked out, and if that doesn't settle it, all distances are, in whole numbers. Bounds are rounded
outwards, so that they never decide what whole numbers would decide otherwise, ties included.

Sums of parts are added up by Spark; what comes to the driver and goes out to all tasks are the codebooks, which grow with
`entries` and the vectors' length alone.

Vectors that are null or hold null or non-finite components are left out. Shorter vectors are filled with zeros to the
longest one's length, and that to a multiple of `parts`. Rows without an id are coded as others, and come last when the
first codebook is chosen; of rows with the same id, the lesser vector comes first. With fewer rows than `entries`
codebooks have fewer entries. Whole numbers are held within +-2^62, and errors at 2^63 - 1. Null labels are one label.
Other columns, whatever their names, are left aside; no vectors, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written
from quire.llm.vectors import SUMS, added, filled, floors, halves, is_whole, lists, matrix, reach

LONG = (1 << 63) - 1
OUT, IN = 1 + 1e-12, 1 - 1e-12
CHUNK = 2048
STATE = "vec_id long, label {label}, x array<long>, nearest array<int>, upper array<double>, lower array<double>, error long, scans int"


class Book:
    """One part's codebook, and how its entries have moved since the last assignment."""

    def __init__(self, entries: list[list[int]], before: list[list[int]] | None = None, exact: bool = True):
        self.exact = exact  # whether doubles hold all distances
        kind = np.float64 if exact else object
        self.entries = np.array(entries, kind).reshape(len(entries), -1)
        self.squares = (self.entries * self.entries).sum(1)
        k = len(entries)
        between = self.distances(self.entries)
        between[np.arange(k), np.arange(k)] = np.inf
        self.half = np.sqrt(between.min(1).astype(float)) / 2 * IN if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k)
        if before is not None:
            moved = np.sqrt(np.array([float(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(entries, before)])) * OUT
        self.moved = moved
        order = np.argsort(moved)
        self.others = np.full(k, moved[order[-1]])  # how far any entry but this one has moved
        self.others[order[-1]] = moved[order[-2]] if k > 1 else 0.0

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to all entries, exact."""
        if self.exact:
            return (x * x).sum(1)[:, None] - 2 * (x @ self.entries.T) + self.squares
        return ((x[:, None, :] - self.entries[None]) ** 2).sum(2)

    def own(self, x: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        return ((x - self.entries[nearest]) ** 2).sum(1)

    def scanned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest entry, upper, lower bound) of rows."""
        nearest, upper, lower = np.empty(len(x), np.int64), np.empty(len(x)), np.empty(len(x))
        step = CHUNK if self.exact else 64
        for i in range(0, len(x), step):
            d = self.distances(x[i : i + step])
            at, rows = np.argmin(d, 1), np.arange(len(d))
            nearest[i : i + step], upper[i : i + step] = at, np.sqrt(d[rows, at].astype(float)) * OUT
            d[rows, at] = np.inf
            lower[i : i + step] = np.sqrt(d.min(1).astype(float)) * IN
        return nearest, upper, lower

    def assigned(self, x: np.ndarray, nearest: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nearest, upper, lower, whether scanned) after the entries have moved."""
        upper = (upper + self.moved[nearest]) * OUT
        lower = np.maximum(lower - self.others[nearest], 0.0) * IN
        safe = np.maximum(lower, self.half[nearest])
        doubt = np.flatnonzero(~(upper < safe))
        upper[doubt] = np.sqrt(self.own(x[doubt], nearest[doubt]).astype(float)) * OUT
        doubt = doubt[~(upper[doubt] < safe[doubt])]
        nearest = nearest.copy()
        nearest[doubt], upper[doubt], lower[doubt] = self.scanned(x[doubt])
        seen = np.zeros(len(x), bool)
        seen[doubt] = True
        return nearest, upper, lower, seen


def assign(state: DataFrame, books: list[Book], width: int, schema: str) -> DataFrame:
    """The state after an assignment to the books' entries."""
    held, parts = state.sparkSession.sparkContext.broadcast(books), len(books)
    m = width // parts

    def assigned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            whole, n = matrix(batch.column(2), width), batch.num_rows
            first = batch.column(3).null_count == n
            old = [None if first else matrix(batch.column(i), parts) for i in (3, 4, 5)]
            nearest, upper, lower = np.empty((n, parts), np.int32), np.empty((n, parts)), np.empty((n, parts))
            scans, error = np.zeros(n, np.int32), [0] * n
            for p, book in enumerate(held.value):
                x = whole[:, p * m : (p + 1) * m].astype(np.float64 if book.exact else object)
                if first:
                    nearest[:, p], upper[:, p], lower[:, p] = book.scanned(x)
                    scans += 1
                else:
                    nearest[:, p], upper[:, p], lower[:, p], seen = book.assigned(x, *(o[:, p] for o in old))
                    scans += seen
                own = book.own(x, nearest[:, p])
                error = own + error
            error = np.minimum(np.asarray(error, object), LONG) if not held.value[0].exact else np.asarray(error)
            scans += batch.column(7).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(nearest), lists(upper), lists(lower), pa.array(error.astype(np.int64)), pa.array(scans)], ["vec_id", "label", "x", "nearest", "upper", "lower", "error", "scans"])

    return state.mapInArrow(assigned, schema)


def sums(state: DataFrame, parts: int, entries: int, width: int) -> dict[int, int]:
    """By cell: for each part and entry how many parts it has, and then their sums, component by component."""
    m = width // parts

    def summed(batches: Iterator) -> Iterator:
        high, low = np.zeros((parts, entries, m + 1), np.int64), np.zeros((parts, entries, m + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, nearest = matrix(batch.column(0), width), matrix(batch.column(1), parts)
            for p in range(parts):
                order = np.argsort(nearest[:, p], kind="stable")
                mine = nearest[order, p]
                cuts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                x = whole[order, p * m : (p + 1) * m]
                low[p, mine[cuts], 0] += np.diff(np.append(cuts, len(mine)))
                if m:
                    high[p, mine[cuts], 1:] += np.add.reduceat(x >> 32, cuts)
                    low[p, mine[cuts], 1:] += np.add.reduceat(x & 0xFFFFFFFF, cuts)
        yield from halves(high.reshape(-1), low.reshape(-1))

    return added(state.select("x", "nearest").mapInArrow(summed, SUMS))


def codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, scans of each vector; scans: how often all entries were looked at."""
    rows = vectors.filter(is_whole(f"`{vector_col}`")).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), floors(f"`{vector_col}`", scale).alias("x"))
    rows = written(rows, "whole-vectors")
    n, width, most = reach(rows)
    width = -(-width // parts) * parts
    m = width // parts
    rows = filled(rows, width)
    schema = STATE.format(label=dict(rows.dtypes)["label"])
    first = [r.x for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    books = [[x[p * m : (p + 1) * m] for x in first] for p in range(parts)]
    exact = m * (2 * max(most, 1)) ** 2 < 1 << 52
    state = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("nearest", "array<int>"), ("upper", "array<double>"), ("lower", "array<double>"), ("error", "long"))), F.lit(0).alias("scans"))
    before: list = [None] * parts
    for turn in range(rounds + 1 if n else 0):
        state = written(assign(state, [Book(b, a, exact) for b, a in zip(books, before)], width, schema), "coded-vectors")
        if turn == rounds:
            break
        got, k = sums(state, parts, len(first), width), len(first)
        before = books
        cell = lambda p, e, i: got.get((p * k + e) * (m + 1) + i, 0)
        books = [[[cell(p, e, 1 + i) // cell(p, e, 0) for i in range(m)] if cell(p, e, 0) else books[p][e] for e in range(k)] for p in range(parts)]
    text = ",".join(str(c) for b in books for e in b for c in e)
    code = F.array_join(F.transform("nearest", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    coded = state.select("vec_id", "label", code.alias("code"), "error", "scans")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONG).cast("decimal(30,0)")).cast("long").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"), "scans")
