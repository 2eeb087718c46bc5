"""A bitmap of fixed size over keys: which rows may have a partner, before anything is shuffled.

Its size doesn't grow with the keys. More keys only let more rows through; an exact join always follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23


def of_hash(column: str) -> Column:
    """The cell of a 64-bit hash: its upper bits."""
    return F.shiftrightunsigned(F.col(column), 64 - BITS)


def of_id(column: str) -> Column:
    """The cell of an id: its lower bits."""
    return F.col(column).bitwiseAND(F.lit((1 << BITS) - 1))


def bitmap(keys: DataFrame, cell: Column) -> bytes:
    """The cells that keys set. At most 2^BITS distinct cells come to the driver, as one Arrow column."""
    cells = keys.select(cell.cast("int").alias("cell")).distinct().toArrow().column("cell").to_numpy()
    out = np.zeros(1 << BITS, bool)
    out[cells] = True
    return np.packbits(out, bitorder="little").tobytes()


def has_hash(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return _has(bits, hashes.view(np.uint64) >> np.uint64(64 - BITS))


def has_id(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return _has(bits, (ids & ((1 << BITS) - 1)).view(np.uint64))


def _has(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, whose id isn't in gone's doc_id; of the ids in once's, one row each.

    Rows that the bitmap clears stay where they are; only the others are joined. Rows without an id stay.
    """
    known = gone.select("doc_id").dropna().distinct()
    named = known if once is None else known.unionByName(once.select("doc_id").dropna()).distinct()
    held = docs.sparkSession.sparkContext.broadcast(bitmap(named, of_id("doc_id")))

    def part(maybe: bool):
        def parted(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            bits = np.frombuffer(held.value, np.uint8)
            for batch in batches:
                ids = pc.cast(batch.column(at), pa.int64())
                named = has_id(bits, pc.fill_null(ids, 0).to_numpy()) & ~np.asarray(pc.is_null(ids))
                yield batch.filter(pa.array(named == maybe))

        return docs.mapInArrow(parted, docs.schema)

    at = docs.columns.index(id_col)
    doubtful = part(True).join(known.select(F.col("doc_id").alias("_gone_id")), F.col(id_col).cast("long") == F.col("_gone_id"), "left_anti")
    if once is not None:
        doubtful = doubtful.dropDuplicates([id_col])
    return part(False).unionByName(doubtful)
