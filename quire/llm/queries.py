"""The thin queries of the numbered operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.repair import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, spaced=False).drop("ids")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.jaccard import duplicate_components

    return duplicate_components(table(spark, sf_dir, "documents"), n=5, percent=75)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=512)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.winnowing import compare_edits

    return compare_edits(table(spark, sf_dir, "documents"), k=4, w=4)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontamination import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), least=0)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2, size=1024)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.vector_codes import codes

    return codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), most=4, scale=256)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_id_shards": op1_token_id_shards,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_counts": op3_token_counts,
    "op4_winnowing": op4_winnowing,
    "op5_html_text": op5_html_text,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_whitening": op12_whitening,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_BITS = ", ".join(f"'{i:04b}'" for i in range(16))
_DIGIT = "substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(f"{1 << 4 - k} * CAST(substring(bits, 5 * i + {k + 1}, 1) AS INT)" for k in range(5)) + ", 1)"

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op9_warc": f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
        s AS (SELECT page_id, url, strlen(h) AS payload_bytes, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: [{_BITS}][instr('0123456789abcdef', c)]), '') AS bits, first FROM p JOIN f USING (h))
        SELECT page_id, url, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {_DIGIT}), '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM s""",
}
