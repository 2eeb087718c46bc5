"""Codes against plain rounds over all distances."""

import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.llm.vector_codes import codes
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v], l) for i, v, l in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), l) for i, v, l in kept]
    m, first = width // parts, sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * m : (p + 1) * m] for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for turn in range(rounds + 1):
        at = [[near(v[p * m : (p + 1) * m], books[p]) for p in range(parts)] for _, v, _ in kept]
        if turn == rounds:
            break
        for p in range(parts):
            members = [[v[p * m : (p + 1) * m] for (_, v, _), a in zip(kept, at) if a[p] == e] for e in range(len(books[p]))]
            books[p] = [[sum(c) // len(of) for c in zip(*of)] if of else books[p][e] for e, of in enumerate(members)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(far(v[p * m : (p + 1) * m], books[p][a[p]]) for p in range(parts)) for (_, v, _), a in zip(kept, at)]
    labels = {}
    for (_, _, l), e in zip(kept, errors):
        labels[l] = labels.get(l, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for e in a), e, labels[l], sha) for (i, _, l), a, e in zip(kept, at, errors)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.drop("scans").collect()), key=str)


def test_given_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    rows = list(zip(*(t.column(c).to_pylist() for c in ("vec_id", "embedding", "label"))))
    df = codes(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert got(df) == brute(rows)
    assert df.agg(F.sum("scans")).first()[0] < 0.8 * 4 * 5 * len(rows), "bounds spare scans"


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_copies(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-2, 3, 8) / 4).tolist(), int(rng.integers(3)) or None) for i in range(120)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(codes(df, entries=16)) == brute(rows, entries=16)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 6, 1), (2, None, 1), (3, [1.0, None, 1.0, 1.0], 2), (4, [nan] * 4, 2), (5, [inf] * 4, None), (None, [0.25] * 8, None), (7, [-0.1], None), (7, [-0.1], None), (8, [], 3), (9, [1e30] * 5, 4), (10, [-3e4] * 8, 4)]
    kept = [(i, [max(-(1 << 62) / 1024, min((1 << 62) / 1024, c)) for c in v] if v and i == 9 else v, l) for i, v, l in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"x": F.lit("x"), "code": F.lit(1), "scans": F.lit(2)})
    want = [(*r[:2], min(r[2], (1 << 63) - 1), min(r[3], (1 << 63) - 1), r[4]) for r in brute(kept, entries=3)]
    assert got(codes(df, entries=3)) == want


def test_none(spark):
    assert got(codes(spark.createDataFrame([], SCHEMA))) == got(codes(spark.createDataFrame([(1, None, 1)], SCHEMA))) == []
    assert got(codes(spark.createDataFrame([(1, [], 1)], SCHEMA))) == brute([(1, [], 1)])
