"""Ids and counts of whole texts are the libraries' own."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.token_counts import Counter, count_tokens
from quire.llm.tokens import Encoder

ODD = ["", " ", "  a  b ", "x\n\n  y", " lead", "trail ", "a b", "don't we'll  <|endoftext|> x <|endoftext|>", "日本語 テキスト ΣΑΣ Σ", "12345 67 3.14", "İstanbul ß ẞ", "é ́a", "a\x1c b \x1fc",
       "tab\t x", "emoji 😀 x", "É <|startoftext|> x", " é́ ", "foo's 'tis ''s, \"quoted\" (x) y.z", "a" * 300, "\n", "x y 　z", "word " * 500, "I'M HE'LL", "a_b-c"]


@pytest.fixture(scope="module")
def corpus(docs_text):
    return ODD + docs_text


@pytest.fixture(scope="module")
def encoders():
    return {n: (Tokenizer.from_file(public_tokenizers.path(n)), Encoder(public_tokenizers.path(n), spaced)) for n, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))}


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids(corpus, name, spaced):
    file = public_tokenizers.path(name)
    library, ours, small = Tokenizer.from_file(file), Encoder(file, spaced), Encoder(file, spaced, limit=10)
    for text in corpus:
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.of(text), "<u4").tolist() == expected, text[:80]
        assert np.frombuffer(small.of(text), "<u4").tolist() == expected, text[:80]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("limit,most", [(500_000, 1 << 20), (100, 2000), (10, 1)])
def test_many_at_once(corpus, name, spaced, limit, most):
    file = public_tokenizers.path(name)
    library, ours = Tokenizer.from_file(file), Encoder(file, spaced, limit=limit)
    texts = ["'s", "'tis 'll", "x\vy 's", "é's ''s 'S", *corpus, "y" * 5000 + " z", "\v", "ab\ncd \x1c"] + ["'re" + t for t in corpus[:60]]
    got = [np.frombuffer(x, "<u4").tolist() for x in ours.all(texts, most)]
    assert len(got) == len(texts)
    for text, ids in zip(texts, got):
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abest 's'll\n\v\tÉß19.,<|"), max_size=30), max_size=6))
def test_any_texts(encoders, name, spaced, texts):
    library, ours = encoders[name]
    for text, ids in zip(texts, ours.all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_count_rows(spark):
    """Nulls, repeated rows, clashing names, a long text, an empty table, and a bound that is just reached."""
    texts = [(1, "a b"), (1, "a b"), (None, "x"), (3, None), (4, ""), (5, "word " * 200_000), (6, "é" * 700)]
    df = spark.createDataFrame([(d, t, 7, "z") for d, t in texts], "doc_id long, text string, n_tokens int, n_bytes string").repartition(3)
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    expected = sorted(((d or -1), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2) for d, t in texts)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, file, limit=2).collect()) == expected
    assert count_tokens(df.limit(0), file).collect() == []


def test_counts(corpus):
    file = public_tokenizers.path("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(file), Counter(file)
    for text in corpus:
        assert ours.of(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]
