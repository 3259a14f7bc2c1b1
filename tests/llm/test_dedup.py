"""Exact dedup: no text is lost or kept twice, whatever the cut of the scan."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from girthkit.llm import dedup

CUT = "spark.sql.files.minPartitionNum"


@pytest.fixture
def recut(spark):
    yield
    spark.conf.unset(CUT)


def kept_texts(rows):
    return Counter(r.text for r in rows if r.kept)


def test_cut_of_the_scan_changes(spark, tmp_path, recut):
    path = f"file://{tmp_path}/docs"
    spark.range(4000, numPartitions=8).selectExpr("id AS doc_id", "concat('text ', id * 7919 % 50) AS text").write.parquet(path)
    docs = spark.read.parquet(path)
    spark.conf.set(CUT, "3")
    found, first = dedup.exact_dedup(docs), dedup.keep_first(docs)
    spark.conf.set(CUT, "40")
    want = Counter(f"text {k}" for k in range(50))
    assert kept_texts(found.collect()) == want
    assert Counter(r.text for r in first.collect()) == want


def test_null_and_repeated_keys_and_clashing_columns(spark):
    rows = [(None, "a", 1), (None, "a", 2), (3, "a", 3), (3, "a", 3), (None, "b", 4), (None, " b", 5), (None, "b  ", 6), (None, "b ", 7), (9, None, 8), (8, "", 9), (7, "c", 10)]
    names = ["slot", "mask", "word", "heavy", "number", "hash", "first", "keep_number", "keep_key", "doc", "rows", "bits"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").select("*", *[F.col("place").alias(n) for n in names])
    got = dedup.exact_dedup(docs)
    assert got.columns == [*docs.columns, "text_sha256", "keep_id", "group_size", "kept"]
    got = got.collect()
    assert all(r[n] == r.place for r in got for n in names) and sorted(r.place for r in got) == sorted(r[2] for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for group in by.values():
        keys = [r.doc_id for r in group if r.doc_id is not None]
        assert [r.group_size for r in group] == [len(group)] * len(group)
        assert {r.keep_id for r in group} == {min(keys) if keys else None}
        (kept,) = [r for r in group if r.kept]
        assert kept.doc_id == kept.keep_id
    assert sorted(len(g) for g in by.values()) == [1, 1, 1, 2, 2, 4]
    first = dedup.keep_first(docs)
    assert first.columns == docs.columns and first.count() == 6


def test_filter_grows_with_the_rows_and_lets_unique_rows_pass(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 256) AS text_sha256")
    alone, repeated = dedup.split_repeated(rows, "text_sha256")
    assert alone.count() > 19000 and alone.count() + repeated.count() == 20000
    both = rows.union(rows.filter("doc_id % 100 = 0"))
    assert dedup.split_repeated(both, "text_sha256")[0].filter("doc_id % 100 = 0").count() == 0
    assert dedup.filter_words(10, 2) < dedup.filter_words(10**6, 2) < dedup.filter_words(10**12, 2) == 64 * dedup.FILTER_WORDS


def test_without(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "id AS word")
    got = dedup.without(rows, spark.range(0, 1000, 3).toDF("doc_id"), "doc_id")
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(1000) if i % 3]
    assert dedup.without(rows, rows.limit(0), "doc_id").count() == 1000
