"""Corpus pipeline: quality classifier, quality rules, near-dedup, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All columns of
docs are kept as they are, whatever their names, by all stages but the last. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import minhash, packing, quality_classifier, quality_rules
from weft.llm.queries import WORD_VOCABULARY, table
from weft.llm.storage import materialize


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant rejects go. It learns from the labelled rows of ``docs`` outside of the held-out quarter.

    A null or empty text is scored from its zeros; equal rows stay or go together; without labels every score is 0.5, so that all go.
    """
    measured = materialize(quality_classifier.features(docs), "features")
    model = quality_classifier.train(measured, table(spark, sf_dir, "labels"), ~quality_classifier.held_out())
    return quality_classifier.filter_rows(docs, model)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go; null and empty texts are among them."""
    return quality_rules.filter_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id: five words, similarity of 0.8 or more.

    Of rows that repeat an id, the one with the least text; rows without an id stay.
    """
    return minhash.filter_rows(docs, minhash.MinHash(words=5, numerator=80))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 4096 tokens. A null or empty text is one piece, its end id."""
    return packing.best_fit(docs, WORD_VOCABULARY)


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL engine encodes with this vocabulary or fits the discriminant: tested against a brute-force version.
ORACLE_SQL = None
