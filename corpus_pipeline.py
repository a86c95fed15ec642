"""Documents made ready for training: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever they
are. A null text counts as empty. A null id is an id like any other, of which one row stays where one of each group does. Of rows
that repeat, the dedup stages keep one; the other stages keep all they keep of one. Empty documents give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import exact_dedup, packing, pii, quality, simhash
from shelfmark.operators.workspace import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from these documents and the labels, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the one with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by runs of five words and a similarity of 0.8 or more, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars is the new length."""
    return pii.redacted(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", no_exact_copies),
    ("simhash_near_dedup", no_near_copies),
    ("pii", no_personal_data),
    ("best_fit_packing", packed),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
