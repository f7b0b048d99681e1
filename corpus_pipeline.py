"""From raw documents to packed sequences, one written table after another.

Quality classifier, exact dedup, near dedup, mixing to source weights, packing.
Every stage reads what the one before has written. Stages that find a row
without ``doc_id`` treat it as their operators say; an empty table goes through
all stages and gives no piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factledger.llm import exact_dedup, mixing, near_copies, packing, quality
from factledger.llm.common import new_path, read
from factledger.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.learning_labels(read(spark, sf_dir, "labels")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts."""
    return exact_dedup.unique_rows(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more.

    Links come from SimHash, by the method of ``op1_simhash``, and from MinHash
    bands where three differing bits don't reach.
    """
    return near_copies.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pieces(docs, tokenizer("word_bpe_49k.json"), with_ids=False).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("exact_dedup", unique),
    ("near_dedup", distinct),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't express the classifier, the fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
