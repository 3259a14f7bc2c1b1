"""Questions of blocks to a table dealt by hash range, and the answers.

A block is a part of a scan; it asks with sorted 64-bit keys in compressed
blobs, one a range, and is answered in the order of its question, so answers
carry no keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, local_path
from .words import stretch, unique, unpack


def edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each hash range begins in sorted keys, and their end."""
    top = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, top), [len(keys)]])


def merge(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The blobs of a range in the order of their blocks: the place of each key
    among the distinct ones, each distinct one's first row, and where the
    blocks after the first begin."""
    table = table.sort_by("block")
    keys = [unpack(b) for b in table.column("keys").to_pylist()]
    _, first, codes = unique(np.concatenate(keys))
    return table, codes, first, np.cumsum([len(k) for k in keys])[:-1]


def rows_of(path: str, block: int, columns: list[str]) -> pa.Table:
    """The rows of a block in a table that by_block() made; of its scan
    partition's files only the row groups that hold them are read."""
    import pyarrow.parquet as pq

    system, folder = local_path(path)
    return pq.read_table(f"{folder}/bucket={block >> 20}", filesystem=system, partitioning=None, columns=columns, filters=[("block", "=", block)])


def fetched(path: str, block: int, n: int, dtype: type) -> list[np.ndarray]:
    """The answers to a block's question about order n, one a range."""
    table = rows_of(path, block, ["n", "part", "answer"])
    table = table.filter(pc.equal(table.column("n"), n)).sort_by("part")
    return [stretch(b, dtype) for b in table.column("answer").to_pylist()]


def fetch(path: str, block: int, n: int, dtype: type) -> np.ndarray:
    """The same, range after range."""
    return np.concatenate([np.zeros(0, dtype), *fetched(path, block, n, dtype)])


def by_range(asked: DataFrame, bits: int, orders: int = 1) -> DataFrame:
    """Questions dealt to as many tasks as half the ranges, so that a task's
    share does not grow with the input."""
    return asked.repartition(max(2, orders << bits >> 1), *[c for c in ("n", "part") if c in asked.columns])


def by_block(answers: DataFrame, docs: DataFrame, name: str) -> str:
    """Answers as a table with a folder for each partition of the scan of docs
    (the upper bits of a block's number), sorted by block."""
    path = fresh_path(answers.sparkSession, name)
    dealt = answers.withColumn("bucket", F.shiftright("block", 20)).repartition(max(2, docs.rdd.getNumPartitions()), "bucket")
    dealt.sortWithinPartitions("bucket", "block").write.option("parquet.block.size", 4 << 20).partitionBy("bucket").parquet(path)
    return path


def hash_bits(docs: DataFrame) -> int:
    """Two ranges for each 16 MB of the scan, as bits of the hash."""
    spark = docs.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(4, min(24, (2 * docs.rdd.getNumPartitions() * max(1, size >> 24) - 1).bit_length()))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (their dots as two underscores) for a while."""
    wanted = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def brief_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files go when the query that wrote them ends."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def same_scan(spark: SparkSession) -> AbstractContextManager[None]:
    """The same cut of a scan in every pass, whatever executors come and go,
    and small Arrow batches."""
    cut = spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)
    return settings(spark, spark__sql__files__minPartitionNum=cut, spark__sql__execution__arrow__maxRecordsPerBatch="1000")
