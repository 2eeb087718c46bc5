"""Quality by naive Bayes support vectors.

Indicators of word n-grams are scaled by the log ratio of their smoothed shares in the two classes, rows are brought to
length 1, and a linear hinge-loss model is fitted to them by dual coordinate descent. The score is the logistic of the
margin, `steep` times steeper than one unit of margin for one of log odds. Texts are seen as words, signs and their shapes only: labels, language, source and id are no features.

The model is fitted on up to `per_class` labelled rows of each class; every row of docs is scored. Null and empty texts
have no features and get the model's bias alone; without rows of both classes every score is 0.5. Repeated rows are
scored one by one, and a null doc_id stays null. A score of 0.5 counts as good. A text of any length is scored whole, by
its distinct n-grams. Other columns of docs and labels, whatever their names, are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import texts
from quire.llm.labelled import featured, fitted, kept_rows, sample
from quire.llm.textvec import SIGN, Words, grams, lower_ascii, mix, words_and_signs

BITS = 20
_SHIFT = np.uint64(64 - BITS)


def shapes(w: Words) -> np.ndarray:
    """For each word a hash of its shape (digit, lower, Capital, UPPER, or a repeat of the word before it, signs aside), for
    signs the signs themselves."""
    first = w.data[w.starts]
    second = w.data[np.minimum(w.starts + 1, w.ends - 1)]
    upper = lambda b: (b >= 65) & (b <= 90)
    code = np.where((first >= 48) & (first <= 57), 1, np.where(upper(first), 2 + upper(second), 4)).astype(np.uint64)
    text = w.texts
    for back in (1, 2):
        again = (w.hashes[back:] == w.hashes[:-back]) & (text[back:] == text[:-back])
        code[back:][again] = 9
    return np.where(w.kinds == SIGN, w.hashes, mix(code))


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words and pairs of words, and runs of one to three shapes."""
    text, out = w.texts, []
    shaped = Words(w.data, w.bounds, w.sums, shapes(w), w.starts, w.ends, w.firsts, w.kinds)
    for salt, (of, n) in enumerate(((w, 1), (w, 2), (shaped, 1), (shaped, 2), (shaped, 3))):
        h, at = grams(of, n)
        out.append((text[at], mix(h + np.uint64(salt)) >> _SHIFT))
    return np.concatenate([t for t, _ in out]), np.concatenate([f for _, f in out])


def fit(xs: list[np.ndarray], ys: np.ndarray, cost: float = 1.0, smoothing: float = 1.0, least: int = 3, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight of each feature times its ratio, the ratios, bias): hinge loss, dual coordinate descent over the rows in a new order each epoch."""
    size = 1 << BITS
    weights = np.zeros(size, np.float32)
    if len(set(ys.tolist())) < 2:
        return weights, weights, 0.0
    count = lambda y: np.bincount(np.concatenate([x for x, v in zip(xs, ys) if v == y] or [np.zeros(0, np.int64)]), minlength=size).astype(float)
    good, bad = count(1), count(0)
    seen = good + bad >= least
    p, q = np.where(seen, good + smoothing, 0), np.where(seen, bad + smoothing, 0)
    ratio = np.zeros(size)
    ratio[seen] = np.log(p[seen] / p.sum() / (q[seen] / q.sum()))
    rows = [x[seen[x]] for x in xs]
    values = [ratio[x] for x in rows]
    values = [v / (np.linalg.norm(v) or 1.0) for v in values]
    sign = np.where(ys == 1, 1.0, -1.0)
    square = np.array([v @ v + 1.0 for v in values])  # 1 for the bias
    w, bias, alpha, rng = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    return (w * ratio).astype(np.float32), ratio.astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = 4096, **how) -> bytes:
    """The model, fitted on a bounded sample of the labelled rows: bias, then 2^BITS weights and 2^BITS squared ratios."""

    def learned(xs, _, ys):
        weights, ratios, bias = fit(xs, ys, **how)
        return np.float64(bias).tobytes() + weights.tobytes() + (ratios * ratios).tobytes()

    return fitted(docs, sample(labels, target, per_class), words_and_signs(), lower_ascii(), features, learned)


def scores_of(model: bytes, steep: float = 4.0):
    """A function from a batch and a string column's place to the scores of its rows."""
    known = bool(model)
    bias = float(np.frombuffer(model, "<f8", 1)[0]) if known else 0.0
    weights, squares = np.frombuffer(model, "<f4", offset=8).reshape(2, -1) if known else np.zeros((2, 1 << BITS), np.float32)

    def scores(batch, column: int) -> np.ndarray:
        out = [np.zeros(0)]
        for _, i, j, text, feature, _ in featured([batch], words_and_signs(), lower_ascii(), features, column):
            total, square = np.bincount(text, weights[feature], j - i), np.bincount(text, squares[feature], j - i)
            margin = np.divide(total, np.sqrt(square), out=np.zeros(j - i), where=square > 0) + bias  # of the row at length 1, as fitted
            out.append(1 / (1 + np.exp(-np.clip(steep * margin, -500, 500))))
        return np.concatenate(out)

    return scores


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher is better) of each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scores = scores_of(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch, 1))], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(scored, "doc_id long, score double")


def keep_good(docs: DataFrame, model: bytes, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score `least` or more."""
    return kept_rows(docs, text_col, model, lambda model: (lambda f: lambda batch, column: f(batch, column) >= least)(scores_of(model)))


def held_out(id_col: str = "doc_id"):
    """Rows that the model never learns from: crc32 of the id as text leaves 1 when divided by 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, per_class: int = 4096) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs, by a model that learns from the rows that aren't held out."""
    rows = score(docs, train(docs, labels.filter(~held_out()), per_class=per_class))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
