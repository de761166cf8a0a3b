"""From documents to packed training sequences, in five stages over all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratawave.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from stratawave.llm.common import cut, forget, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels given, scores below 0.7; null texts count as empty, repeated rows stay, rows without doc_id go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the largest doc_id; null and empty texts are equal, repeated rows become one, rows without doc_id go."""
    return exact_dedup.dedup_documents(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the smallest doc_id; texts without words are near nothing and stay, repeated rows become one, rows without doc_id go."""
    return near_dedup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, secrets replaced by a mark; null texts stay null."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens; null texts are one piece with the end id alone, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written and read again, and deleted when the next one is written. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, cut(stage(spark, docs, sf_dir), name)
        forget(last)
    return docs


#: A trained model and a tokenizer are no SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None
