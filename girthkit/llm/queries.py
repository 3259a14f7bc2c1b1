"""The queries of this folder, each on its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, jaccard, katz, merkle, packing, pieces, quality, secrets, toxicity, warc
from .common import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine and its executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), min_bytes=0)


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"), order=3, held=(7, 2))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held=(3, 1))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held=(4, 2))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(dedup.normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    return dedup.resolve(docs, "doc_id").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_ALL = (
    op1_warc_chain, op2_katz_backoff, op3_pieces, op4_merkle, op5_ngram_jaccard,
    op6_best_fit, op7_secrets, op8_toxicity, op9_quality, op10_exact_dedup,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {"op1_warc_chain": warc.ORACLE, "op10_exact_dedup": dedup.ORACLE}
