"""Cells and sample of op6 are as large as they were, without arrays of all cells."""

import inspect
import tracemalloc

import numpy as np

from quire.llm import toxicity


def test_cells_and_sample():
    assert toxicity.BITS == 24
    assert {inspect.signature(f).parameters["per_class"].default for f in (toxicity.train, toxicity.judge)} == {4096}


def test_fit_counts_only_what_is_there():
    rng = np.random.default_rng(3)
    ys = np.arange(400) % 2
    marks = np.array([5, 70_000, (1 << 24) - 1])
    xs = [np.unique(np.r_[rng.integers(0, 1 << 24, 50), marks if y else marks[:0]]).astype(np.uint32) for y in ys]
    tracemalloc.start()
    keep, weights, thresholds = toxicity.fit(xs, [np.ones(len(x), np.uint16) for x in xs], ys)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keep.tolist() == marks.tolist() and (weights > 0).all() and len(thresholds) == 3
    assert most < 32 << 20  # one array of all cells, of 8 bytes each, has 128 MB
