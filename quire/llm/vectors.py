"""What the operators on vectors share: whole numbers of their components, exact sums, integers in Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers are held within this, so that their differences fit a long.
MOST = 1 << 62


def is_whole(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(F.col(vector), bad), F.lit(False))


def floors(vector: str, scale: int) -> Column:
    """array<long>: floor(scale * c) of every component, as doubles; held within MOST."""
    return F.transform(F.col(vector), lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c.cast("double") * F.lit(float(scale))))))


def filled(rows: DataFrame, width: int) -> DataFrame:
    """Vectors x of fewer components get zeros up to width."""
    return rows.withColumn("x", F.when(F.size("x") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))))


def reach(rows: DataFrame) -> tuple[int, int, int]:
    """(rows, longest vector, largest absolute component) of rows with x."""
    n, width, low, high = rows.agg(F.count("*"), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    return n, width or 0, max(abs(low or 0), abs(high or 0))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column of longs as rows of a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), width)


def lists(x: np.ndarray):
    """The rows of a matrix as an Arrow list column."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1)))


def added(cells: DataFrame) -> dict[int, int]:
    """Exact sums of (cell, high, low), low being 32 bits wide: one whole number for each cell, of which there are few."""
    got = cells.groupBy("cell").agg(*(F.sum(F.col(c).cast("decimal(20,0)")).cast("string").alias(c) for c in ("high", "low"))).toArrow()
    return {c: (int(h) << 32) + int(l) for c, h, l in zip(*(got.column(i).to_pylist() for i in range(3)))}


SUMS = "cell long, high long, low long"


def halves(totals: np.ndarray, low: np.ndarray) -> Iterator:
    """A batch of SUMS: totals of the upper parts and of the lower 32 bits, by cell."""
    import pyarrow as pa

    some = np.flatnonzero((totals != 0) | (low != 0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some]), pa.array(low[some])], ["cell", "high", "low"])
