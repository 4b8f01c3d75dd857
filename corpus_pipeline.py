"""A training corpus from `documents`: toxicity, near duplicates, benchmark passages, secrets, tokens.

Each stage works on all rows that the one before has kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm.bpe import token_digests
from shardloom.llm.common import shared_dir, stored, table
from shardloom.llm.decontaminate import drop_contaminated
from shardloom.llm.jaccard import keep_one_of_each
from shardloom.llm.secrets import redact
from shardloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more. Null and empty texts are scored like any other; labels without an id teach nothing."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id. Texts without words are duplicates of nothing and stay."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item. Null texts and items hold nothing and are in nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; a null text stays null."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but text, with the number of tokens and digests of the ids and of what they decode to."""
    return token_digests(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]
ORACLE_SQL = None  # toxicity scores and byte-level BPE have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, folder, f"{i}-{name}")
    return docs
