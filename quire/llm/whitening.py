"""Whitening of vectors: a covariance in tiles, its eigenvectors, and every vector on the first of them.

Components become whole numbers, floor(scale * c). The fit list holds every distinct vector once. Its covariance is worked
out tile by tile: the fit list is cut into row-blocks of up to BLOCK vectors, and each of these into blocks of neighbouring
dimensions; the column blocks are shuffled by their row-block, each pair of them makes a tile of products, centred first, and Spark adds up what all
row-blocks give to a tile's cells. The driver gets one number for each pair of dimensions, however many vectors there are, puts the
tiles together and takes the eigenvectors.

Vectors that are null or hold null or non-finite components are left out. Shorter vectors are filled with zeros to the
longest one's length. Rows without an id and repeated rows each give their rows; the fit list knows equal vectors
once. Fewer than `most` dimensions give as many components. A component without variance (an eigenvalue of at most 1e-12 of the first)
has a whitened value of 0 and is left out of identity_error; vectors without any variance have an explained share of 0. Of
eigenvectors the largest entry is positive. Whole numbers are held within +-2^62, deviations at 2^63 - 1. Other columns,
whatever their names, are left aside; no vectors, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written
from quire.llm.vectors import SUMS, added, filled, floors, halves, is_whole, matrix, reach

BLOCK = 2048
LONG = (1 << 63) - 1


def totals(fit: DataFrame, width: int) -> list[int]:
    """The exact sum of each dimension."""

    def summed(batches: Iterator) -> Iterator:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), width)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield from halves(high, low)

    got = added(fit.select("x").mapInArrow(summed, SUMS))
    return [got.get(i, 0) for i in range(width)]


def column_blocks(fit: DataFrame, width: int, tile: int, kind: str) -> DataFrame:
    """(row_block, col_block, numbers) of the fit list; numbers: a column block's whole numbers, row by row."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = 0
        for batch in batches:
            x = matrix(batch.column(0), width).astype(kind)
            for i in range(0, len(x), BLOCK):
                row = (TaskContext.get().partitionId() << 32) + made
                made += 1
                blocks = [np.ascontiguousarray(x[i : i + BLOCK, c : c + tile]).tobytes() for c in range(0, width, tile)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["row_block", "col_block", "numbers"])

    return fit.select("x").mapInArrow(cut, "row_block long, col_block int, numbers binary")


def covariance(fit: DataFrame, n: int, width: int, most: int, mean: np.ndarray, tile: int | None = None) -> np.ndarray:
    """The fit list's covariance, divisor n, from tiles of its dimension pairs; tile: dimensions of a column block."""
    tile = tile or max(16, -(-width // 8))
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 1 << bits)
    blocks = column_blocks(fit, width, tile, kind)
    left, right = (blocks.select("row_block", F.col("col_block").alias(f"{s}_block"), F.col("numbers").alias(f"{s}_numbers")) for s in ("left", "right"))
    pairs = left.join(right, "row_block").filter("left_block <= right_block").select("left_block", "right_block", "left_numbers", "right_numbers")

    def multiplied(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tiles: dict[tuple[int, int], np.ndarray] = {}
        centred = lambda c, numbers: np.frombuffer(numbers, kind).reshape(-1, len(mean[c * tile : (c + 1) * tile])) - mean[c * tile : (c + 1) * tile]
        for batch in batches:
            for i, j, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                tiles[i, j] = tiles.get((i, j), 0) + centred(i, a).T @ centred(j, b)
        for (i, j), sums in tiles.items():
            row, col = np.indices(sums.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(row + i * tile), pa.array(col + j * tile), pa.array(sums.reshape(-1))], ["i", "j", "part"])

    got = pairs.mapInArrow(multiplied, "i long, j long, part double").groupBy("i", "j").agg(F.sum("part").alias("part")).toArrow()
    i, j, part = (got.column(k).to_numpy() for k in range(3))
    out = np.zeros((width, width))
    out[i, j] = part / n
    out[j, i] = part / n
    return out


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the first ones by falling eigenvalue."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1][:most], 0.0), vectors[:, ::-1][:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def identity_error(fit: DataFrame, n: int, width: int, mean: np.ndarray, projection: np.ndarray) -> float:
    """How far the covariance of the fit list's whitened values is from the identity, measured over all of them."""
    k = projection.shape[1]

    def multiplied(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros((k + 1, k))
        for batch in batches:
            y = (matrix(batch.column(0), width) - mean) @ projection
            sums[:k] += y.T @ y
            sums[k] += y.sum(0)
        row, col = np.indices(sums.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(sums.reshape(-1))], ["i", "j", "part"])

    got = fit.select("x").mapInArrow(multiplied, "i long, j long, part double").groupBy("i", "j").agg(F.sum("part").alias("part")).toArrow()
    sums = np.zeros((k + 1, k))
    sums[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy()
    of = sums[:k] / n - np.outer(sums[k] / n, sums[k] / n)
    return float(np.abs(of - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, most: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", tile: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.filter(is_whole(f"`{vector_col}`")).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), floors(f"`{vector_col}`", scale).alias("x"))
    rows = written(rows, "whole-vectors")
    _, width, largest = reach(rows)
    if not width:
        return rows.sparkSession.createDataFrame([], schema)
    rows = filled(rows, width)
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    n = fit.count()
    total = totals(fit, width)
    mean = np.array([s / n for s in total])
    found = covariance(fit, n, width, largest, mean, tile)
    values, directions = components(found, most)
    trace = float(np.trace(found))
    varied = values > values[0] * 1e-12
    projection = np.where(varied, directions / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    error = identity_error(fit, n, width, mean, projection[:, varied])
    explained = values / trace if trace > 0 else np.zeros(len(values))
    small = (2 * n * max(largest, 1)) ** 2 * width < 1 << 63
    kind = np.int64 if small else object
    sums = np.array(total, kind)
    k = len(values)

    def projected(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, size = matrix(batch.column(1), width), batch.num_rows
            y = (x - mean) @ projection
            deviation = ((x.astype(kind) * n - sums) ** 2).sum(1)
            deviation = (deviation if small else np.minimum(deviation, LONG)).astype(np.int64)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(size), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)), pa.array(np.repeat(deviation, k)), pa.array(y.reshape(-1)), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(projected, schema)
