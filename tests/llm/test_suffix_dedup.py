"""Removed bytes against a plain search for strings that start twice."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import suffix_dedup
from quire.llm.suffix_dedup import Records, Run, front_coded, merged, remove_repeats
from quire.llm.common import table
from tests.conftest import SF

SCHEMA = "doc_id long, text string"


def brute(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in data for p in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "ünï", "x"]) for _ in range(n))


def planted(seed):
    rng = random.Random(seed)
    passages = [words(rng, rng.randint(30, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = words(rng, rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            text += " " + p[a : a + rng.randint(100, 500)] + words(rng, rng.randint(0, 20))
        rows.append((i, text))
    return rows + [(100 + i, rows[i][1]) for i in range(5)] + [(200 + i, rows[i][1][:-7] + "other") for i in range(10)]


def test_given_table(spark):
    docs = table(spark, SF, "documents")
    assert got(remove_repeats(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed,limits", [(0, {}), (1, {"HOT": 2, "HOTTEST": 1 << 20}), (2, {"HOT": 2, "HOTTEST": 6}), (3, {"RANGE": 40, "SPLITTERS": 3, "RUN": 64}), (4, {"RANGE": 20, "CHUNK": 700})])
def test_passages(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = planted(seed)
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    a, b = words(rng, 60), words(rng, 80)
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, "d" * 600), (None, a), (None, a), (7, a), (7, b), (7, b), (8, "\0" * 250), (9, "\0" * 230 + "x"), (10, "é" * 150), (11, a[:199]), (12, a[:200] + "!"), (13, b[50:] + "\0" * 3), (14, "\0" + b[40:])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"d1": F.lit("x"), "hash": F.lit(1), "spans": F.lit(1)})
    assert got(remove_repeats(df)) == brute(rows)


def test_periods_and_long_text(spark):
    rng = random.Random(6)
    rows = [(1, "ab" * 3000), (2, "".join(rng.choice("xyz") for _ in range(50_000))), (3, "ab" * 90 + "q" * 30 + "ab" * 100), (4, ("0123456789" * 7 + "-") * 40)]
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_none(spark):
    assert got(remove_repeats(spark.createDataFrame([], SCHEMA))) == []
    assert got(remove_repeats(spark.createDataFrame([(1, None)], SCHEMA))) == brute([(1, None)])


@pytest.mark.parametrize("seed", range(4))
def test_merge_keeps_order_and_prefixes(seed):
    rng, length = np.random.default_rng(seed), 200
    coded, every = [], []
    for _ in range(int(rng.integers(1, 9))):
        n = int(rng.integers(1, 40))
        body = np.zeros((n, length + length - suffix_dedup.K), np.uint8)
        body[:, :length] = rng.integers(0, 2, (n, length)) * (rng.random((n, length)) < 0.03)
        body = body[np.lexsort(body[:, :length].T[::-1])]
        zero = np.zeros(n, np.int64)
        coded.append(front_coded(Records(length, body, zero, zero, zero, zero, np.arange(n), zero)))
        every += [r[:length].tobytes() for r in body]
    runs = [Run(c, length) for c in coded]
    who, where, common = merged(runs, length)
    out = [runs[w].suffixes[i] for w, i in zip(who, where)]
    assert out == sorted(every)
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), length)
    assert common == [0] + [lcp(a, b) for a, b in zip(out, out[1:])]
