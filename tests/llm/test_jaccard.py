"""Components against brute force over all pairs."""

import random
import re

import pytest

from quire.llm.jaccard import duplicate_components, one_of_each


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, percent=75):
    sets = {d: shingle_set(t) for d, t in docs if d is not None}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: root(d) for d in ids}


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, passage = [], some(40)
    for base in range(12):
        text = some(rng.choice([3, 5, 6, 30, 80]))
        for _ in range(rng.choice([1, 2, 9])):
            t = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            docs.append(" ".join(t))
    docs += [" ".join(some(20) + passage + some(10)) for _ in range(15)] + [" ".join(passage)] * 3 + [" ".join(["a"] * 50)] * 2 + [" ".join(["a"] * 90), "A  b\tC", "a b c", "", None, " \n "]
    chain = some(60)
    for _ in range(20):  # each links with its neighbours, the ends not with each other
        docs.append(" ".join(chain))
        chain = chain[2:] + some(2)
    rng.shuffle(docs)
    return [(3 * i + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,stars", [(0, 2), (1, 0), (2, 1)])
def test_components(spark, seed, stars):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in docs], "doc_id long, text string, node long, token string").repartition(3)
    got = {r.doc_id: r for r in duplicate_components(df, stars=stars).collect()}
    assert {d: r.component_id for d, r in got.items()} == brute(docs)
    assert all(got[d].n_shingles == len(shingle_set(t)) for d, t in docs)


def test_odd_rows(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (2, text), (7, None), (8, "")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id) for r in duplicate_components(df).collect())
    assert rows == [(-1, None), (2, 2), (5, 2), (5, 2), (7, 7), (8, 8)]
    assert duplicate_components(df.limit(0)).collect() == []
    kept = sorted((r.doc_id or -1) for r in one_of_each(df).collect())
    assert kept == [-1, 2, 7, 8]
    assert [r.doc_id for r in one_of_each(df.filter("doc_id = 5")).collect()] == [5]
