"""A corpus from raw documents to packed sequences: STAGES, each a call of one operator, and run() over all of them.

quality: documents below a score of 0.5 go. toxicity: documents that are toxic go. near duplicates: of each component the
document with the smallest id stays. decontamination: documents that overlap with a benchmark item go. packing: what is
left is cut into pieces, each with its place in a sequence.

Rows with the same id and text are judged one by one by quality and toxicity; of each id one row comes out of the Jaccard
stage; rows without an id pass it. Null texts are empty. Without labels of both classes quality keeps all (a score of
0.5) and toxicity rejects none; without benchmark items nothing is contaminated; without documents there are no pieces.
Stages pass all columns on, whatever their names, but for packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontamination, jaccard, packing, quality, toxicity
from quire.llm.common import table, written
from quire.llm.queries import _tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels").filter(~quality.held_out())))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, n=5, percent=75)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, _tokenizer("byte_bpe_50k.json"), end_id=2, size=1024)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", no_near_duplicates),
    ("benchmark decontamination", no_benchmark),
    ("best-fit packing", packed),
]

#: SQL cannot express the classifiers; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
