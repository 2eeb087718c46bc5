"""Re-Pair shards give back what went in, from any place, and ids are numbered across shards."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.repair import Shard, compress, expand, round_trip, shard_bytes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=200), st.integers(2, 4))
def test_expands_to_the_same(ids, least):
    ids = np.array(ids, np.uint32)
    x, lefts, rights, sizes, base = compress(ids, least=least)
    assert expand(x, lefts, rights, sizes, base).tolist() == ids.tolist()
    assert len(x) <= len(ids)
    assert_exhausted(x, least)


def assert_exhausted(x, least):
    """No pair is left that occurs `least` times."""
    pairs = Counter(zip(x[:-1].tolist(), x[1:].tolist()))
    assert max(pairs.values(), default=0) < least


def test_production_values():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 400, n) for n in rng.integers(1, 9, 300)]
    ids = np.concatenate([words[i] for i in rng.zipf(1.3, 20_000) % 300]).astype(np.uint32)
    x, lefts, rights, sizes, base = compress(ids)
    assert_exhausted(x, 2)
    assert len(x) < len(ids) / 4 and sizes.max() > 20
    assert (expand(x, lefts, rights, sizes, base) == ids).all()
    assert compress(ids, step=7)[0].size < len(ids) / 4


def test_random_access():
    ids = np.random.default_rng(1).integers(0, 20, 30_000).astype(np.uint32)
    shard = Shard(shard_bytes(0, 0, [5, None], ids, np.array([0, 10_000, 30_000])))
    assert len(shard.symbols) < len(ids) and (shard.all_ids() == ids).all()
    for start, n in ((0, 1), (0, 30_000), (12_345, 678), (29_999, 1), (15_000, 0)):
        assert (shard.read_span(start, n) == ids[start : start + n]).all()
    assert np.concatenate([shard.read_span(s, 1000) for s in range(0, 30_000, 1000)]).tolist() == ids.tolist()
    assert shard.doc_ids[1] == -(2**63)


def test_damage():
    with pytest.raises(ValueError):
        Shard(b"x" * 100)


def test_round_trip(spark):
    docs = [(7, "B b b " * 50), (-3, "A a a a " * 40), (9, None), (8, ""), (None, "null id"), (9, None), (2**40, "é ß İ")]
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in docs], "doc_id long, text string, start int, ids string")
    file = public_tokenizers.path("word_bpe_49k.json")
    rows = sorted(round_trip(df.repartition(3), file, 1, False, shard_ids=100).collect(), key=lambda r: (r.start, r.n_tokens))
    library, before = Tokenizer.from_file(file), 0
    assert [r.doc_id for r in rows] == [None, -3, 7, 8, 9, 9, 2**40]
    texts = dict(docs)
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (before, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        before += len(ids)
    assert round_trip(df.limit(0), file, 1, False).collect() == []
