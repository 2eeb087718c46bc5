"""Whitening against numpy over all distinct vectors at once."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.llm.whitening import whiten
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, most=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    fit = [list(v) for v in {tuple(v) for _, v in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in kept:
        deviation = sum((n * x - s) ** 2 for x, s in zip(v, sums))
        for c in range(min(most, width)):
            y = (np.array(v) - np.array([s / n for s in sums])) @ vectors[:, c] / np.sqrt(values[c]) if values[c] > 1e-12 * values[0] else 0.0
            out.setdefault((i, c + 1), []).append((n, deviation, y, values[c] / values.sum() if values.sum() > 0 else 0.0))
    return out


def alike(df, rows, most=4):
    want, got = brute(rows, most), {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
        assert r.identity_error <= 1e-4
    assert got.keys() == want.keys()
    signs = {}
    for key, have in got.items():
        for (n, d, y, e), (wn, wd, wy, we) in zip(sorted(have), sorted(want[key])):
            assert (n, d) == (wn, min(wd, (1 << 63) - 1)) and e == pytest.approx(we, rel=1e-6, abs=1e-12)
            if abs(wy) > 1e-3:
                assert signs.setdefault(key[1], np.sign(y * wy)) == np.sign(y * wy)
            assert abs(y) == pytest.approx(abs(wy), rel=1e-6, abs=1e-6)


def test_given_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    rows = list(zip(*(t.column(c).to_pylist() for c in ("vec_id", "embedding"))))
    for tile in (None, 7, 64):
        alike(whiten(spark.read.parquet(f"{SF}/embeddings.parquet"), tile=tile), rows)


def test_copies_count_once(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(50)]
    rows += [(100 + i, rows[0][1]) for i in range(200)]
    alike(whiten(spark.createDataFrame(rows, SCHEMA)), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(20)] + [(None, [1.0, 2.0]), (3, [1.0]), (3, [1.0]), (4, None), (5, [None, 1.0, 1.0]), (6, [float("nan")] * 3), (7, [float("inf")] * 3), (8, []), (9, [1e5, -1e5, 3e6])]
    alike(whiten(spark.createDataFrame(rows, SCHEMA).withColumns({"x": F.lit("x"), "n": F.lit(1)})), rows)


def test_no_variance(spark):
    got = whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(v, c, 1, 0, 0.0, 0.0, 0.0) for v in (1, 2) for c in (1, 2)]
    line = [(i, [float(i), 2.0 * i]) for i in range(5)]
    got = whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert all(r.whitened == 0 for r in got if r.component == 2) and all(r.identity_error < 1e-9 for r in got)


def test_none(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == whiten(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
