"""A corpus pipeline: quality, exact and near duplicates, mixing, tokens. Each stage works on all that the one before has kept.

All stages: columns may be null, texts empty or of any length, rows may repeat, and columns besides those of documents may have
any name and are handed on; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import exact_dedup, minhash, mixing, quality, sentencepiece_bpe
from docloom.llm.common import kept, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row stays or goes by its own text and language; a text without a character goes. Repeated rows stay or go alike."""
    return quality.without_rejected(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, null texts being empty ones."""
    return exact_dedup.without_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays; texts without words stay."""
    return minhash.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row is repeated as often as the mix takes it, at most three times; texts without words are not taken."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gives one row of digests, repeated rows repeated ones; a null text is empty."""
    return sentencepiece_bpe.round_trip(docs)


STAGES = [("quality", good_quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mix), ("sentencepiece", tokens)]
#: Training a model, band keys and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs, "zstd")
    return docs
