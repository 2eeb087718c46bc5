"""What the two classifiers share: hashed features of texts, a bounded sample of labelled rows, fitting in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import texts
from quire.llm.textvec import Words, runs

#: Features of a run of texts: (text, feature) pairs, the same pair once or more often.
Featurizer = Callable[[Words], tuple[np.ndarray, np.ndarray]]


def sample(labels: DataFrame, target: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y): up to per_class labelled rows of each class 0 and 1, those whose hashed ids come first.

    Rows without an id or a label are left out; of a document that is labelled twice, the lower label counts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    first, second = (known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1))
    return first.unionByName(second)


def featured(batches: Iterator, classes: np.ndarray, fold: np.ndarray, featurize: Featurizer, column: int = 1) -> Iterator[tuple]:
    """(batch, from, to, text, feature, count): each text's distinct features, by text and feature."""
    for batch in batches:
        for i, j, words in runs(batch.column(column), classes, fold):
            text, feature = featurize(words)
            keys, n = np.unique((text.astype(np.uint64) << np.uint64(32)) | feature.astype(np.uint64), return_counts=True)
            yield batch, i, j, (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), n


def fitted(docs: DataFrame, chosen: DataFrame, classes: np.ndarray, fold: np.ndarray, featurize: Featurizer, fit: Callable[[list, list, np.ndarray], bytes], id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """What fit makes of the chosen rows' features, counts and classes. `chosen` is a bounded sample, so one task holds it."""

    def features(batches):
        import pyarrow as pa

        for batch, i, j, text, feature, n in featured(batches, classes, fold, featurize):
            cut = np.searchsorted(text, np.arange(j - i + 1))
            rows = [(feature[a:b].astype("<u4").tobytes(), np.minimum(n[a:b], 65535).astype("<u2").tobytes()) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "y", "features", "counts"])

    def learned(rows):
        import pyarrow as pa

        rows = rows.sort_by([("doc_id", "ascending")])
        xs = [np.frombuffer(b, "<u4") for b in rows.column("features").to_pylist()]
        ns = [np.frombuffer(b, "<u2") for b in rows.column("counts").to_pylist()]
        return pa.table({"model": pa.array([fit(xs, ns, rows.column("y").to_numpy())], pa.binary())})

    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    rows = rows.mapInArrow(features, "doc_id long, y int, features binary, counts binary")
    got = rows.groupBy().applyInArrow(learned, "model binary").collect()
    return bytes(got[0][0]) if got else b""


def kept_rows(docs: DataFrame, text_col: str, model: bytes, judge: Callable[[bytes], Callable]) -> DataFrame:
    """The rows of docs, all columns, for which judge(model)(batch, the text column's place) is true. Nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        good = judge(held.value)
        for batch in batches:
            texts_of = pa.RecordBatch.from_arrays([pc.fill_null(batch.column(at), "")], ["text"])
            yield batch.filter(pa.array(good(texts_of, 0)))

    return docs.mapInArrow(kept, docs.schema)
