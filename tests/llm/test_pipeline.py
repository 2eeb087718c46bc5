"""The pipeline's stages against brute force on a small corpus, and the queries' results."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from quire.llm import decontamination, quality, toxicity  # noqa: E402
from quire.llm.common import table, written  # noqa: E402
from tests.llm.test_jaccard import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, SF), "test-stage")
        ids = {r.doc_id for r in docs.collect()}
        if i < 4:
            assert docs.columns == columns and ids <= set(before) and ids
        if name == "n-gram Jaccard join":
            assert ids == set(brute(sorted(before.items())).values())
        if name == "benchmark decontamination":
            frame = spark.createDataFrame(sorted(before.items()), "doc_id long, text string")
            assert ids == set(before) - {r.doc_id for r in decontamination.overlaps(frame, table(spark, SF, "benchmark")).collect()}
        if name == "best-fit packing":
            assert ids == set(before)
        seen.append(ids)
    assert len(seen) == 5


def test_filters_reject_what_the_scores_say(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out()))
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.5}
    model = toxicity.train(docs, labels)
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {r.doc_id for r in toxicity.grade(docs, model).collect() if not r.toxic}


def test_names():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


@pytest.mark.parametrize("column", ["score", "severity", "component_id", "_leak", "token"])
def test_clashing_columns(spark, column):
    docs = table(spark, SF, "documents").limit(0).unionByName(spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumn(column, docs.doc_id)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert column in docs.columns
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert column not in packed.columns and {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        df = table(spark, SF, name)
        (df.limit(0) if name == empty else df.limit(60)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()  # whatever so few rows teach the classifiers, nothing breaks
    assert empty != "documents" or rows == []
