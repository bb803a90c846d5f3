"""A training corpus from documents, in stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.llm import factorization, ngram_jaccard, secrets, sentencepiece_scan, source_mixing, store
from statuta.llm.queries import MODEL_FILE
from statuta.llm.ship import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; a null text counts as empty, repeated rows share their verdict."""
    ship(spark)
    return factorization.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 5-word shingles at a Jaccard of 0.8 or more; of repeated rows one."""
    ship(spark)
    return ngram_jaccard.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, up to three times each."""
    ship(spark)
    return source_mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of each document of the mix."""
    ship(spark)
    return sentencepiece_scan.encode(docs, MODEL_FILE)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("secret scans", without_secrets), ("mixing sources", mixed), ("SentencePiece", encoded)]

#: SQL cannot train the classifier; tests/llm/test_pipeline.py compares each stage's rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; between them, tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k + 1 == len(STAGES) else store.table(docs)
    return docs
