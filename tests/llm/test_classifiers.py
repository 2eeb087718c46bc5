"""Quality and toxicity: held-out accuracy, the parts against plain versions, odd rows."""

import random
import zlib

import numpy as np
import pytest

from quire.llm import quality, toxicity
from quire.llm.labelled import sample
from quire.llm.textvec import grams, lower_ascii, powers, runs, split, words_and_signs, words_only

SF = "/root/testdata/sf0.01"


def arrow(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def test_words():
    texts = ["", "Ab ab  AB\tx", "é!e", " ", "a,b"]
    for column in (arrow(texts), arrow(["skip"] + texts)[1:]):
        for most in (1, 4, 1 << 20):
            seen = []
            for i, j, w in runs(column, words_only(), lower_ascii(), most):
                for t in range(j - i):
                    seen.append([bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.firsts[t] : w.firsts[t + 1]], w.ends[w.firsts[t] : w.firsts[t + 1]])])
            assert seen == [["Ab", "ab", "AB", "x"] if t == texts[1] else t.split() for t in texts]
    _, _, w = next(runs(arrow(texts), words_only(), lower_ascii()))
    assert len(set(w.hashes[:3].tolist())) == 1 and w.hashes[3] != w.hashes[0]
    _, _, v = next(runs(arrow(["a,b é."]), words_and_signs(), lower_ascii()))
    assert [bytes(v.data[a:b]).decode() for a, b in zip(v.starts, v.ends)] == ["a", ",", "b", "é", "."]
    h, at = grams(w, 2)
    assert at.tolist() == [0, 1, 2] and h[0] == h[1] != h[2]
    assert (powers(5)[0] * powers(5)[1] == 1).all()
    assert len(split(np.zeros(0, np.uint8), np.zeros(1, np.int64), words_only(), lower_ascii()).hashes) == 0


def test_dual_descent_matches_a_plain_solver():
    """The fitted weights reach (nearly) the least hinge loss that plain subgradient steps find."""
    rng = np.random.default_rng(0)
    xs = [np.unique(rng.integers(0, 30, 8)) for _ in range(80)]
    ys = np.array([int((x < 10).sum() > 2) for x in xs])
    weights, ratios, bias = quality.fit(xs, ys, least=1, epochs=200)
    good, bad = (np.bincount(np.concatenate([x for x, y in zip(xs, ys) if y == k]), minlength=30) + 1.0 for k in (1, 0))
    ratio = np.log(good / good.sum() / (bad / bad.sum()))
    rows = np.zeros((80, 30))
    for i, x in enumerate(xs):
        rows[i, x] = ratio[x]
        rows[i] /= np.linalg.norm(rows[i])
    assert np.allclose(ratios[:30], ratio, atol=1e-5)
    sign = 2 * ys - 1
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - sign * (rows @ w + b)).sum()
    mine = loss(np.divide(weights[:30], ratio, out=np.zeros(30), where=ratio != 0), bias)
    w, b, best = np.zeros(30), 0.0, np.inf
    for t in range(1, 6000):
        hit = (1 - sign * (rows @ w + b)) > 0
        w, b = w - (w - (sign * hit) @ rows) / (t + 50), b - (b - (sign * hit).sum()) / (t + 50)
        best = min(best, loss(w, b))
    assert mine <= best * 1.02


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    again = {r.doc_id: r.score for r in quality.judge(docs.repartition(3), labels.repartition(2)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in rows)


def test_served_margin_is_the_fitted_one():
    """Scores are the logistic of the margin of the row at length 1, worked out here feature by feature."""
    import pyarrow as pa

    good, bad = ["calm green river bends slowly past old mills"] * 3, ["buy cheap pills now now click click here"] * 3
    xs = []
    for t in good + bad:
        for _, _, w in runs(pa.array([t]), words_and_signs(), lower_ascii()):
            xs.append(np.unique(quality.features(w)[1]).astype(np.int64))
    ys = np.array([1, 1, 1, 0, 0, 0])
    weights, ratios, bias = quality.fit(xs, ys, least=1)
    model = np.float64(bias).tobytes() + weights.tobytes() + (ratios * ratios).tobytes()
    texts = ["calm green pills now", "river click", "", "unseen entirely", good[0] * 50]
    got = quality.scores_of(model, steep=4.0)(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), 0)
    for t, score in zip(texts, got):
        f = [np.unique(quality.features(w)[1]).astype(np.int64) for _, _, w in runs(pa.array([t]), words_and_signs(), lower_ascii())][0]
        row = ratios[f].astype(float)
        norm = np.sqrt((row**2).sum())
        plain = np.divide(weights[f], ratios[f], out=np.zeros(len(f)), where=ratios[f] != 0)
        assert score == pytest.approx(1 / (1 + np.exp(-4 * ((plain @ row / norm if norm else 0.0) + bias))), rel=1e-4)


def test_ordinal_matches_a_plain_likelihood():
    """The cumulative-link fit reaches (nearly) the least penalised loss that slow numeric descent finds, for any start."""
    rng = np.random.default_rng(5)
    n, top, m = 4, 3, 120
    rows, grades = [], []
    for _ in range(m):
        c = np.flatnonzero(rng.random(n) < 0.5)
        v = 1.0 + rng.random(len(c))
        rows.append((c, v))
        grades.append(int(np.clip(np.round((v * np.array([0.2, 0.9, 0.0, 0.5])[c]).sum() + rng.normal(0, 0.5)), 0, top)))
    grades = np.array(grades)
    weight = np.where(grades > 0, 0.5 / (grades > 0).sum(), 0.5 / (grades == 0).sum())

    def loss(w, thresholds, ridge=3e-4):
        z = np.array([w[c] @ v for c, v in rows])
        p = np.c_[np.ones(m), 1 / (1 + np.exp(-(z[:, None] - thresholds))), np.zeros(m)]
        chance = np.maximum(p[np.arange(m), grades] - p[np.arange(m), grades + 1], 1e-12)
        return -(weight * np.log(chance)).sum() + 0.5 * ridge * (w @ w)

    w, thresholds = toxicity.ordinal(rows, grades, n, top)
    assert (np.diff(thresholds) > 0).all() and (w >= 0).all()
    free, best = np.r_[np.full(n, 0.1), -1.0, 0.0, 0.0], np.inf
    unpack = lambda x: (np.maximum(x[:n], 0), x[n] + np.r_[0.0, np.cumsum(np.exp(x[n + 1 :]))])
    step = np.full(len(free), 0.5)
    for _ in range(600):  # coordinate search, no slopes used
        for i in range(len(free)):
            for by in (step[i], -step[i]):
                tried = free.copy()
                tried[i] += by
                if loss(*unpack(tried)) < best:
                    best, free = loss(*unpack(tried)), tried
                    break
            else:
                step[i] *= 0.7
        if step.max() < 1e-5:
            break
    assert loss(w, thresholds) <= best * 1.01 + 1e-4


def test_labels_are_all_that_is_learned_from(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", (quality.held_out() != (labels.quality == 1)).cast("int"))
    a, b = ({r.doc_id: r.score for r in quality.judge(docs, x).collect()} for x in (labels, turned))
    assert a == b


def frame(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abdeglmnorst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["vilegrub", "vilegrot", "dungheap"]
    rows = []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.choice([5, 40, 400]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.choice([1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "s", "ling"])
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(d, t, 1) for d, t, _ in rows], "doc_id long, text string, toxic int")
    return docs, spark.createDataFrame([(d, y, 1) for d, _, y in rows], "doc_id long, toxic int, text int"), rows


def test_toxicity_held_out(spark):
    docs, labels, rows = frame(spark)
    got = {r.doc_id: r for r in toxicity.judge(docs, labels.filter("doc_id < 400")).collect()}
    truth = {d: y for d, _, y in rows}
    wrong = [d for d in range(400, 600) if got[d].toxic != bool(truth[d])]
    assert len(wrong) <= 4
    assert all(0 <= r.severity <= 3 and r.grade in (0, 1, 2, 3) for r in got.values())
    assert np.mean([got[d].severity for d in truth if truth[d]]) > 1 > 0.2 > np.mean([got[d].severity for d in truth if not truth[d]])
    kept = {r.doc_id for r in toxicity.keep_clean(docs, toxicity.train(docs, labels)).collect()}
    assert len({d for d in truth if not truth[d]} ^ kept) <= 6


def test_thresholds_keep_their_order():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 4, 300)
    rows = [(np.array([0, 1]), np.array([g + rng.normal(0, 0.5), 1.0])) for g in grades]
    w, thresholds = toxicity.ordinal(rows, grades, 2, 3, ridge=1e-4, steps=3000)
    assert (np.diff(thresholds) > 0).all() and w[0] > 1
    z = np.array([w[c] @ v for c, v in rows])
    assert np.mean(np.abs((z[:, None] > thresholds).sum(1) - grades) <= 1) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "x y"), (2, ""), (2, "w " * 30000), (3, "z" * 100000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert {r.score for r in quality.judge(docs, labels).collect()} == {0.5}
        assert {(r.severity, r.grade, r.toxic) for r in toxicity.judge(docs, labels).collect()} == {(0.0, 0, False)}
        assert quality.keep_good(docs, quality.train(docs, labels)).count() == 5 and toxicity.keep_clean(docs, toxicity.train(docs, labels)).count() == 5
    assert quality.judge(docs.limit(0), one).collect() == [] and toxicity.judge(docs.limit(0), one).collect() == []
    assert sorted(map(tuple, sample(spark.createDataFrame([(1, 1), (1, 0), (5, 1)], "doc_id long, q int"), "q", 5).collect())) == [(1, 0), (5, 1)]
