"""Fingerprints against a plain version that tries every window, and the edited texts."""

import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from quire.llm.winnowing import SEGMENT, compare_edits, fingerprint, with_next

TOKEN = regex.compile(r"[^ \t\n\x0b\f\r\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{1,24}|[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
LOW = (1 << 24) - 1


def entries(spark, text, k, w):
    """The positions that windows choose, from Spark's hash of each run alone."""
    tokens = TOKEN.findall(text)
    n = max(len(tokens) - k + 1, 1)
    runs = [(i, (tokens[i : i + k] + [None] * k)[:k]) for i in range(n)]
    df = spark.createDataFrame(runs, "i int, t array<string>")
    h = dict(df.select("i", F.expr(f"xxhash64({', '.join(f'CASE WHEN t[{j}] IS NULL THEN CAST(NULL AS BIGINT) ELSE xxhash64(t[{j}]) END' for j in range(k))})")).collect())
    h = {i: v >> 24 for i, v in h.items()}
    chosen = []
    for s in range(max(n - w + 1, 1)):
        window = range(s, min(s + w, n))
        least = min(h[i] for i in window)
        i = max(i for i in window if h[i] == least)
        if (h[i], i) not in chosen:
            chosen.append((h[i], i))
    return chosen


@pytest.mark.parametrize("text", ["", "one", "a b c d", "a b c d e f g h i j k l m n", "x " * 50, "日本語の文章です and words", "w" * 100, "a b  c\n\nd e f g"])
def test_entries(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(fingerprint("text", 4, 4)).first()[0]
    assert [(e >> 24, LOW - (e & LOW)) for e in got] == entries(spark, text, 4, 4)


def test_segments_and_guarantee(spark):
    rng = random.Random(0)
    words = [f"w{rng.randrange(500)}" for _ in range(3 * SEGMENT)]
    shared = [f"s{i}" for i in range(7)]
    texts = [" ".join(words), " ".join(words[:5000] + shared + words[5000:]), " ".join(["q"] * 9 + shared + ["r"] * 9)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(fingerprint("text"))
    a, b, c = (r[0] for r in df.collect())
    positions = [LOW - (e & LOW) for e in a]
    assert positions == sorted(positions) and max(y - x for x, y in zip(positions, positions[1:])) <= 4
    assert {e >> 24 for e in b} & {e >> 24 for e in c}


def test_compare(spark):
    docs = [(5, "alpha beta gamma delta epsilon zeta eta theta iota"), (3000, "one two three four five six seven"), (1, "é" * 10), (9000, None), (7, "alpha beta gamma delta epsilon zeta eta theta iota")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, marks int").repartition(3)
    got = {r.doc_id: r for r in compare_edits(df).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    for i, (d, t) in enumerate(order):
        t, follows = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + follows[: len(t) // 3]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[5].fingerprint == got[7].fingerprint and got[7].near_next == 1.0
    assert compare_edits(df.limit(0)).collect() == []
    one = compare_edits(df.filter("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(4, "b b"), (4, "b b"), (None, "n"), (2, "c")], "doc_id long, text string")
    rows = compare_edits(df).collect()
    assert len(rows) == 4 and sum(r.doc_id is None for r in rows) == 1
    assert sorted(r.near_next for r in rows if r.doc_id == 4) == [0.0, 1.0]


@pytest.mark.parametrize("shape", ["stray", "nulls", "one id", "mixed"])
def test_blocks_by_ranks(spark, shape):
    """Whatever the ids are, blocks are of like size and every row is followed by the next one."""
    rng = random.Random(shape)
    word = lambda: "".join(rng.choice("abcdé日") for _ in range(rng.randint(0, 9)))
    ids = {"stray": [*range(1999), 1 << 40], "nulls": [None] * 1000 + [*range(1000)], "one id": [7] * 1000 + [-(1 << 63), (1 << 63) - 1], "mixed": [None] * 300 + [3] * 300 + [4] * 5 + [rng.randrange(-(1 << 60), 1 << 60) for _ in range(400)]}[shape]
    docs = [(d, f"{word()} {word()} {i}") for i, d in enumerate(ids)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    want = {r: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}
    got = with_next(df, F.lit(1), block_rows=100).collect()
    assert len(got) == len(docs) and {(r.doc_id, r.text): r.next_text for r in got} == want
