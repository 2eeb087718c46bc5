"""Components against a plain union of links."""

import random

import pytest

from quire.llm.components import components, merged


def plain(links):
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {x: root(x) for x in label}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(100, 130)]
    star = [(500, 501 + i) for i in range(40)]
    links = chain + star + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(1, 1), (7, 3), (7, 3)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    expected = {k: v for k, v in plain([x for x in links if x[0] != x[1]]).items()}
    assert {r.node: r.label for r in components(frame(links)).collect()} == expected
    more = [(100, 500), (900, 130), (60, 61)]
    assert {r.node: r.label for r in merged(merged(None, frame(links)), frame(more)).collect()} == plain([x for x in links if x[0] != x[1]] + more)
    assert components(frame(links).limit(0)).collect() == []
