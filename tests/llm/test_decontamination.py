"""Overlaps against brute force over all alignments."""

import random
import re

from quire.llm.decontamination import MASKS, best_overlap, clean, overlaps


def words(t):
    return re.findall(r"[^\W_]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(doc, item, least=10, share=0.75, penalty=2.0, shortest=1):
    """The most agreeing words along any alignment that has a seed; 0 if none counts."""
    a, b = words(doc), words(item)
    if len(b) < shortest:
        return 0
    masks = [m for m in MASKS if len(m) <= len(b)] or ["1" * len(b)]
    best = 0
    for s in range(-len(b) + 1, len(a)):
        lo, hi = max(0, -s), min(len(b), len(a) - s)
        same = [a[i + s] == b[i] for i in range(lo, hi)]
        if not any(all(same[p + k] for k, c in enumerate(m) if c == "1") for m in masks for p in range(len(same) - len(m) + 1)):
            continue
        top = (0.0, 0, 0)
        for i in range(len(same)):
            for j in range(i + 1, len(same) + 1):
                n = sum(same[i:j])
                score = n - penalty * (j - i - n)
                if score > top[0]:
                    top = (score, n, i)
        if top[1] >= min(least, share * len(b)):
            best = max(best, top[1])
    return best


def test_overlaps(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(60)] + ["Été", "naïve"]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(n))) for i, n in enumerate([40, 25, 12, 7, 5, 3])] + [(6, None), (7, "")]
    docs = []
    for d in range(60):
        t = some(rng.choice([5, 60, 150]))
        if d % 2:
            piece = items[rng.randrange(6)][1].split()
            cut = piece[: rng.choice([len(piece), len(piece) // 2])]
            for _ in range(rng.choice([0, 1, len(cut) // 6])):
                cut[rng.randrange(len(cut))] = "other"
            at = rng.randrange(len(t))
            t[at:at] = cut
        docs.append((d, ", ".join(t).upper() if d % 5 == 0 else " ".join(t)))
    docs += [(60, None), (61, ""), (62, items[0][1] + "!")]
    df = spark.createDataFrame([(d, t, 3) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    tests = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.n_same for r in overlaps(df, tests).collect()}
    expected = {(d, i): n for d, t in docs for i, u in items if (n := brute(t, u))}
    assert got == expected and len(got) > 10
    kept = {r.doc_id for r in clean(df, tests).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert clean(df, tests).columns == df.columns


def test_best_overlap():
    import numpy as np

    assert best_overlap(np.array([1, 1, 0, 1, 1, 1], bool), 2.0) == (0, 6, 5)  # of equals, the longest
    assert best_overlap(np.zeros(4, bool), 2.0)[2] == 0


def test_odd_rows(spark):
    item = " ".join(f"k{i}" for i in range(30))
    docs = spark.createDataFrame([(1, item), (1, item), (None, item), (2, "a " * 40000 + item)], "doc_id long, text string")
    tests = spark.createDataFrame([(5, item), (5, item), (None, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_same, r.doc_word) for r in overlaps(docs, tests).collect()) == [(1, 5, 30, 0), (2, 5, 30, 40000)]
    assert [r.doc_id for r in clean(docs, tests).collect()] == [None]
    assert overlaps(docs.limit(0), tests).collect() == [] and overlaps(docs, tests.limit(0)).collect() == []
    assert clean(docs, tests.limit(0)).count() == 4


def test_every_overlap_has_a_seed():
    """All patterns of short items, and random longer ones, without a seed condition."""
    import itertools

    import numpy as np

    from quire.llm.decontamination import lengths_of

    for least, share, penalty in ((10, 0.75, 2.0), (6, 0.5, 1.0), (10, 0.75, 0.5)):
        lengths = lengths_of(least, share, penalty, 4)
        last = max(max(of) for of in lengths.values())
        rng, n_found = random.Random(7), 0
        some = ([rng.random() < p for _ in range(n)] for n in (20, 40, 90) for p in (0.6, 0.7, 0.8, 0.9) for _ in range(100))
        for same in itertools.chain.from_iterable([(itertools.product((False, True), repeat=n) for n in (4, 5, 6, 7, 8, 10, 11)), (some,), ([[k % 5 != r for k in range(n)] for n in (15, 60, 200) for r in range(5)],)]):
            for s in same:
                n = len(s)
                start, to, agree = best_overlap(np.array(s), penalty)
                if agree >= min(least, share * n):
                    n_found += 1
                    mine = [m for m, of in lengths.items() if min(n, last) in of]
                    assert any(all(s[p + k] for k, c in enumerate(m) if c == "1") for m in mine for p in range(start, to - len(m) + 1)), (s, penalty)
        assert n_found > 500


def test_substituted_items(spark):
    """Every fifth word substituted, and short items with a miss, are found."""
    items = [(n, [f"w{n}x{k}" for k in range(n)]) for n in (4, 5, 6, 7, 8, 10, 15, 60)]
    docs = [(n, " ".join(["before"] + ["other" if k % 5 == 2 and n != 4 or n == 4 and k == 3 else w for k, w in enumerate(t)] + ["behind"])) for n, t in items]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(n, " ".join(t)) for n, t in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_same for r in overlaps(df, tests).collect()}

    def best(d, t):
        score = lambda s: sum(1 if x else -2 for x in s)
        same = [x == y for x, y in zip(d.split()[1:], t)]
        return sum(max((same[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)), key=score))

    want = {(n, n): b for (n, t), (_, d) in zip(items, docs) if (b := best(d, t)) >= min(10, 0.75 * n)}
    assert got == want and (60, 60) in got and (8, 8) in got and (4, 4) in got


def test_other_scripts(spark):
    """Unspaced scripts by code point, and signs and spaces beyond ASCII, in exact and edited copies."""
    items = [(1, "水は百度で沸騰する。なぜか?"), (2, "ข้าวหอมมะลิมาจากไทย"), (3, "the “quick” brown — fox can’t jump"), (4, "天地玄黄，宇宙洪荒"), (5, "один два три четыре")]
    docs = [
        (1, "前置き、水は百度で沸騰する!なぜか。後"), (2, "เขาว่าข้าวหอมมะลิมาจากไทยครับ"), (3, 'so the "quick" brown - fox can\'t jump high'), (4, "書曰天地玄黄宇宙洪荒日月"),
        (5, "раз　один два…три«четыре»пять"), (6, "天地玄X宇宙洪荒"), (7, "まったく別の文"),
    ]
    got = {(r.doc_id, r.item_id) for r in overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 4)}


def test_words_of_code_points():
    import numpy as np

    from quire.llm.textvec import WORD, code_points, lower_ascii, split

    texts = ["a日本b 1", "é—É’x", "", "𠀀𠀁 z y", "x‍y ไทย", "日"]
    data = "".join(texts).encode()
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    w = split(np.frombuffer(data, np.uint8), bounds, code_points(), lower_ascii())
    got = [[data[w.starts[k] : w.ends[k]].decode() for k in range(a, b) if w.kinds[k] == WORD] for a, b in zip(w.firsts[:-1], w.firsts[1:])]
    assert got == [["a", "日", "本", "b", "1"], ["é", "É", "x"], [], ["𠀀", "𠀁", "z", "y"], ["x‍y", "ไ", "ท", "ย"], ["日"]]


def test_items_of_few_words(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a cat"), (3, "no match"), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "cat"), (11, "The mat!"), (12, "cat sat on"), (13, ""), (14, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in overlaps(docs, items).collect()} == {(1, 10), (2, 10), (1, 11), (1, 12)}
    assert {(r.doc_id, r.item_id) for r in overlaps(docs, items, shortest=3).collect()} == {(1, 12)}
