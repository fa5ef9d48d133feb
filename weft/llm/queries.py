"""The queries that apply these operators to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import bpe, embedding_dedup, html_extract, lm_scoring, minhash, packing, quality_classifier, quality_rules, token_files, token_rollup
from weft.llm.storage import new_path

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents labelled as good; the background: all."""
    return lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHash(words=3, numerator=85))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents in the two vocabularies, by source and language. No SQL engine encodes with these: tested against the library."""
    versions = {"byte_bpe_50k": BYTE_VOCABULARY, "word_bpe_49k": WORD_VOCABULARY}
    return token_rollup.maintain(table(spark, sf_dir, "documents"), new_path(spark, "rollup"), back=True, vocabularies=versions)


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintain(table(spark, sf_dir, "documents"), new_path(spark, "rollup"))


def op9_token_rollup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents, short ones included."""
    return token_rollup.maintain(table(spark, sf_dir, "documents"), new_path(spark, "rollup"), back=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (op1_bpe, op2_token_files, op3_embedding_near_dedup, op4_best_fit_packing, op5_quality_classifier, op6_lm_scoring, op7_html_extraction, op8_minhash_near_dedup, op9_token_counts, op10_quality_rules)

_WORDS, _PIECES = (f"CAST(len(regexp_extract_all(coalesce(text, ''), '{token_rollup.RULES[r]}')) AS BIGINT)" for r in ("words-1", "pieces-1"))

ORACLES = {
    "op9_token_rollup": f"""
        SELECT source, lang, tokenizer_version, CAST(sum(d) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
        FROM (SELECT source, lang, {_WORDS} AS w, {_PIECES} AS p FROM documents) c,
             LATERAL (SELECT 'words-1' AS tokenizer_version, 1 AS d, c.w AS n UNION ALL SELECT 'pieces-1', 1, c.p) t
        WHERE w >= 20
        GROUP BY source, lang, tokenizer_version""",
    "op9_token_rollup_all": f"""
        SELECT source, lang, tokenizer_version, CAST(sum(d) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
        FROM (SELECT source, lang, {_WORDS} AS w, {_PIECES} AS p FROM documents) c,
             LATERAL (SELECT 'words-1' AS tokenizer_version, 1 AS d, c.w AS n UNION ALL SELECT 'pieces-1', 1, c.p) t
        GROUP BY source, lang, tokenizer_version""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{f.__name__: f for f in (*OPERATORS, op9_token_rollup, op9_token_rollup_all)}, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
