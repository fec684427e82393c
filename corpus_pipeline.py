"""Cleaning pipeline over ``documents``: toxicity, quality, exact copies, near copies, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs`` unchanged.

Behaviour on awkward input: rows with null ids or texts go through every stage
like others (null text is empty); rows that repeat both id and text are
copies, of which one stays; an empty table gives an empty result; further
columns of ``docs``, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import exact_dedup, ngram_join, packing, quality, toxicity
from ledgerlens.llm.queries import GOOD_FROM, TOXIC_FROM, vocabulary_file
from ledgerlens.llm.tables import in_fold, ready, stored, table

#: Near copies: five-word shingles, Jaccard similarity of 4/5 or more.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 4, 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    ready(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=lambda i: ~in_fold(i, 4, 2))
    return toxicity.drop_toxic(docs, model, TOXIC_FROM)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality."""
    ready(spark)
    stats = stored(quality.with_statistics(docs), "quality-stats")
    model = quality.fit(stats, table(spark, sf_dir, "labels"), learn=lambda i: ~in_fold(i, 3, 1))
    return quality.drop_poor(docs, model, GOOD_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each distinct text, that of the smallest id."""
    ready(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near copies, that of the smallest id."""
    ready(spark)
    return ngram_join.drop_near_copies(docs, NEAR_WORDS, NEAR_NUM, NEAR_DEN)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    ready(spark)
    return packing.pack(docs, vocabulary_file("word_bpe_49k.json"), added_tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("packing", pack),
]

#: Trained scores and tokenizers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before it wrote."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
