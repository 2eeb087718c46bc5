"""Toxicity grades by a cumulative-link (proportional odds) regression on sparse text features.

Features are words and their beginnings of four to seven bytes. Of these, the ones that set toxic documents apart in the
sample are kept (`least` toxic documents, and a log odds ratio `z` standard errors above `ratio`). The labels know toxic
and clean alone, so a labelled document's grade is 0 where it is clean; toxic documents get 1 to `grades_of`, in equal
parts, by their evidence: their kept features' counts, weighed by the features' log odds ratios. One weight per feature
serves all thresholds: P(grade >= k) is the logistic of (w x - threshold k), and the expected severity is the sum of
these over k.

The model is fitted on up to `per_class` labelled rows of each class; every row of docs is graded. Null and empty texts
have no features and get the severity that the thresholds alone give; without rows of both classes every severity is 0
and nothing is toxic. Repeated rows are graded one by one, and a null doc_id stays null. Of two grades that are as likely
the lower one counts; a chance of just `reject_at` is toxic. Texts of any length are graded whole, by the counts of their
kept features. Other columns of docs and labels, whatever their names, are left aside, or kept by `keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from quire.llm.common import texts
from quire.llm.labelled import fitted, kept_rows, sample
from quire.llm.textvec import Words, lower_ascii, mix, runs, words_and_signs

BITS = 24
BEGINNINGS = (4, 5, 6, 7)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words and the beginnings of longer words."""
    text, shift = w.texts, np.uint64(64 - BITS)
    where, what = [text], [w.hashes >> shift]
    for n in BEGINNINGS:
        h, at = w.beginnings(n)
        where.append(text[at])
        what.append(mix(h + np.uint64(n)) >> shift)
    return np.concatenate(where), np.concatenate(what)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n: int, top: int, ridge: float = 3e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds in ascending order) of a cumulative-link model, by Adam on the weighted mean log likelihood.

    rows: each row's (columns, values). Toxic and clean rows weigh as much in all. Weights stay at 0 or above, since every
    feature was kept for standing with toxic documents; thresholds are a first one and positive gaps, so they keep their order.
    """
    at = np.concatenate([c for c, _ in rows] or [np.zeros(0, np.int64)])
    values = np.concatenate([v for _, v in rows] or [np.zeros(0)])
    of = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    weight = np.where(grades > 0, 0.5 / max((grades > 0).sum(), 1), 0.5 / max((grades == 0).sum(), 1))
    share = np.array([weight[grades >= k].sum() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    free = np.r_[np.zeros(n), start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    first, second, m = np.zeros_like(free), np.zeros_like(free), len(rows)
    for t in range(1, steps + 1):
        w, gaps = free[:n], np.exp(free[n + 1 :])
        thresholds = free[n] + np.r_[0.0, np.cumsum(gaps)]
        z = np.bincount(of, w[at] * values, m)
        p = np.c_[np.ones(m), _logistic(z[:, None] - thresholds), np.zeros(m)]  # P(grade >= k)
        slope = p * (1 - p)
        i = np.arange(m)
        chance = np.maximum(p[i, grades] - p[i, grades + 1], 1e-9)
        up, down = slope[i, grades] / chance, slope[i, grades + 1] / chance
        up, down = up * weight, down * weight
        by_z = down - up
        by_threshold = np.zeros(top)
        np.add.at(by_threshold, grades[grades > 0] - 1, up[grades > 0])
        np.subtract.at(by_threshold, grades[grades < top], down[grades < top])
        tail = np.cumsum(by_threshold[::-1])[::-1]
        slopes = np.r_[np.bincount(at, by_z[of] * values, n) + ridge * w, tail[0], tail[1:] * gaps]
        first = 0.9 * first + 0.1 * slopes
        second = 0.999 * second + 0.001 * slopes**2
        free = free - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        np.maximum(free[:n], 0, out=free[:n])
    return free[:n], free[n] + np.r_[0.0, np.cumsum(np.exp(free[n + 1 :]))]


def _places(keep: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the ascending `keep` of those of x that are in it, and which of x these are."""
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = x.astype(np.int64)
    at = np.minimum(np.searchsorted(keep, x), len(keep) - 1)
    held = np.flatnonzero(keep[at] == x)
    return at[held], held


def values_of(n: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(n)


def fit(xs: list[np.ndarray], ns: list[np.ndarray], ys: np.ndarray, least: int = 3, ratio: float = 2.0, z: float = 1.5, grades_of: int = 3, **how) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept features in ascending order, their weights, thresholds); no thresholds where one class is missing."""
    none = np.zeros(0)
    if len(set(ys.tolist())) < 2:
        return none.astype(np.int64), none, none
    keep, toxic = np.unique(np.concatenate([x for x, v in zip(xs, ys) if v > 0]).astype(np.int64), return_counts=True)
    keep, toxic = keep[toxic >= least], toxic[toxic >= least]
    clean = np.zeros(len(keep), np.int64)
    for x, v in zip(xs, ys):
        if v == 0:
            clean[_places(keep, x)[0]] += 1  # a row has each feature once
    many, few = (ys > 0).sum(), (ys == 0).sum()
    a, b = toxic + 0.5, clean + 0.5
    odds = np.log(a / (many - a + 1)) - np.log(b / (few - b + 1))
    error = np.sqrt(1 / a + 1 / (many - a + 1) + 1 / b + 1 / (few - b + 1))
    strong = odds - z * error > ratio
    keep, odds = keep[strong], odds[strong]
    rows, evidence = [], np.zeros(len(xs))
    for i, (x, n) in enumerate(zip(xs, ns)):
        c, held = _places(keep, x)
        rows.append((c, values_of(n[held])))
        evidence[i] = odds[rows[-1][0]] @ rows[-1][1] if len(rows[-1][0]) else 0.0
    steps = np.quantile(evidence[ys > 0], np.arange(1, grades_of) / grades_of)
    grades = np.where(ys > 0, 1 + np.searchsorted(steps, evidence, "right"), 0)
    weights, thresholds = ordinal(rows, grades, len(keep), grades_of, **how)
    return keep, weights, thresholds


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = 4096, **how) -> bytes:
    """The model, fitted on a bounded sample of the labelled rows."""

    def learned(xs, ns, ys):
        keep, weights, thresholds = fit(xs, ns, ys, **how)
        return np.array([len(keep), len(thresholds)], "<i8").tobytes() + keep.astype("<i8").tobytes() + weights.astype("<f8").tobytes() + thresholds.astype("<f8").tobytes()

    return fitted(docs, sample(labels, target, per_class), words_and_signs(), lower_ascii(), features, learned)


def chances_of(model: bytes):
    """A function from a batch and a string column's place to P(grade >= k) for each row and k from 1 on."""
    n, top = np.frombuffer(model, "<i8", 2).tolist() if model else (0, 0)
    at = np.frombuffer(model, "<i8", n, 16) if n else np.zeros(0, np.int64)
    thresholds = np.frombuffer(model, "<f8", top, 16 + 16 * n) if top else np.full(1, np.inf)
    weights = (np.frombuffer(model, "<f8", n, 16 + 8 * n) if n else np.zeros(0)).astype(np.float32)
    at, weights = at[weights != 0], weights[weights != 0]
    near = np.zeros(1 << 16, bool)  # most features are told by their lower bits, before they are looked up
    near[at & 0xFFFF] = True

    def chances(batch, column: int) -> np.ndarray:
        out = [np.zeros((0, len(thresholds)))]
        for i, j, words in runs(batch.column(column), words_and_signs(), lower_ascii()):
            text, feature = features(words)
            maybe = np.flatnonzero(near[feature & np.uint64(0xFFFF)])
            place, held = _places(at, feature[maybe])  # few words have a weight, so only these are counted
            keys, count = np.unique((text[maybe[held]].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64), return_counts=True)
            z = np.bincount((keys >> np.uint64(32)).astype(np.int64), weights[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)] * values_of(count), j - i)
            out.append(_logistic(z[:, None] - thresholds) * np.isfinite(thresholds))
        return np.concatenate(out)

    return chances


def grade(docs: DataFrame, model: bytes, reject_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade (most likely), toxic (P(grade >= 1) >= reject_at) of each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def graded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        chances = chances_of(held.value)
        for batch in batches:
            p = chances(batch, 1)
            one = np.ones((len(p), 1))
            levels = -np.diff(np.concatenate([one, p, 0 * one], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(levels.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= reject_at)], ["doc_id", "severity", "grade", "toxic"])

    return texts(docs, id_col, text_col).mapInArrow(graded, "doc_id long, severity double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, model: bytes, reject_at: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that aren't toxic."""
    return kept_rows(docs, text_col, model, lambda model: (lambda f: lambda batch, column: f(batch, column)[:, 0] < reject_at)(chances_of(model)))


def judge(docs: DataFrame, labels: DataFrame, per_class: int = 4096) -> DataFrame:
    return grade(docs, train(docs, labels, per_class=per_class))
