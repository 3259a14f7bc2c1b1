"""A corpus pipeline of five stages. Each stage works on all that the one before
kept, is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from girthkit.llm import dedup, jaccard, packing, secrets, toxicity
from girthkit.llm.common import fresh_path, settle_driver, table
from girthkit.llm.queries import pattern, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects as toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays."""
    return dedup.keep_first(docs)


def unlike_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates that hang together the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in as few sequences as can be."""
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_language),
    ("exact_dedup", unique_texts),
    ("ngram_jaccard", unlike_texts),
    ("secret_scan", no_secrets),
    ("best_fit_packing", packed),
]

#: Trained networks and bin completion have no SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        settle_driver(spark)
    return docs
