"""Packing keeps every id once, in order, and bins hold what they can."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm.packing import pack, sum_of_squares


def brute(lengths, size):
    """Bins by trying every open bin and adding up all squares."""
    gaps, where = [], []
    for a in lengths:
        best = None
        for b, g in enumerate(gaps):
            if g >= a:
                after = [*gaps[:b], g - a, *gaps[b + 1 :]]
                cost = sum(n * n for n in np.unique([x for x in after if x], return_counts=True)[1].tolist())
                if best is None or (cost, g) < best[:2]:
                    best = (cost, g, b)
        if best is None:
            gaps.append(size)
            best = (0, size, len(gaps) - 1)
        gaps[best[2]] -= a
        where.append(best[1])
    return where, len(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_sum_of_squares(seed):
    lengths = np.sort(np.random.default_rng(seed).integers(1, 33, 60))[::-1]
    bins, offsets = sum_of_squares(lengths, 32)
    where, n = brute(lengths.tolist(), 32)
    assert (32 - offsets).tolist() == where and bins.max() + 1 == n


def check(rows, docs, file, size):
    library = Tokenizer.from_file(file)
    for doc, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.piece for r in mine] == [*range(len(mine))] and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert all(r.length == size for r in mine[1:])
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [s[0] for s in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= size
    return len(places)


def test_pack(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    docs = [(1, "one two three " * 30), (2, None), (3, ""), (4, "a b c"), (5, "word " * 700), (6, "tie"), (7, "tie")]
    df = spark.createDataFrame([(d, t, 9, "x") for d, t in docs], "doc_id long, text string, piece int, shard string")
    rows = pack(df, file, end_id=2, size=64, shard_docs=3).collect()
    check(rows, docs, file, 64)
    same = pack(df.repartition(5), file, end_id=2, size=64, shard_docs=3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, same))
    assert pack(df.limit(0), file).collect() == []


def test_repeated_rows_and_null_ids(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "x")], "doc_id long, text string")
    rows = pack(df, file, size=16).collect()
    assert len(rows) == 3 and sum(r.doc_id is None for r in rows) == 1
