"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Rows get their number and digest once, in a written table, so every pass sees
the same rows whatever the scan's cut. Pass one sets one bit a row in a Bloom
filter of 64-bit words (sized by the number of rows): a word that was set more
often than it has bits holds a hash twice, and such words are marked in a
second, 64 times smaller filter, which is broadcast (at most FILTER_WORDS
words, whatever the input). Pass two probes every row: one in an unmarked word
is unique for certain and passes straight through; only possibly repeated rows
shuffle, as digest, key and number, and are settled exactly. Beyond
64 * FILTER_WORDS words the filter grows no more, more rows shuffle and the
result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_groups, unused, written

#: Words of a broadcast filter at most: 2^20 rows of 16 bytes.
FILTER_WORDS = 1 << 20


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df's rows with keep_id, group_size, kept and text_sha256.

    Texts are equal when their normalised forms are (their SHA-256s). Of equal
    texts the row with the smallest key stays; a null key loses to any other
    and, of several rows with the same smallest key, one stays (which one is
    open, as nothing tells them apart). Null texts count as empty, and all
    empty texts are equal. An empty table gives an empty result. Other columns
    pass through unchanged, whatever their names; those named like the added
    ones are replaced.
    """
    return resolve(df.withColumn("text_sha256", F.sha2(normalised(F.col(text)).cast("binary"), 256)), key)


def _bit(place: Column) -> Column:
    """A long with the bit of a place (modulo 64) set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def filter_words(rows: int, spread: int) -> int:
    """Words for a number of rows: a power of two, `spread` words a row, as
    far as FILTER_WORDS words of the broadcast filter tell them apart."""
    return min(1 << max(0, (max(rows, 1) * spread - 1).bit_length()), 64 * FILTER_WORDS)


def crowded(hashes: DataFrame, words: int) -> DataFrame:
    """Pass one on a column `hash`: (slot, mask), a bit for each word of the
    filter that holds more rows than bits."""
    word, place = F.pmod("hash", F.lit(words)), F.shiftright(F.col("hash"), 40)
    full = hashes.groupBy(word.alias("word")).agg(F.bit_or(_bit(place)).alias("bits"), F.count("*").alias("rows"))
    return marks(full.filter(F.col("rows") > F.bit_count("bits")).select("word"))


def marks(words: DataFrame) -> DataFrame:
    """Numbers of a column `word` as a filter: (slot, mask)."""
    return words.groupBy(F.shiftright("word", 6).alias("slot")).agg(F.bit_or(_bit(F.col("word"))).alias("mask"))


def probe(rows: DataFrame, hashed: Column, held: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose word is unmarked, rows whose word is marked)."""
    slot, mask, word = (unused(rows, name) for name in ("slot", "mask", "word"))
    held = F.broadcast(held.select(F.col("slot").alias(slot), F.col("mask").alias(mask)))
    probed = rows.withColumn(word, F.pmod(hashed, F.lit(words))).withColumn(slot, F.shiftright(word, 6)).join(held, slot, "left")
    maybe = F.coalesce(F.col(mask).bitwiseAND(_bit(F.col(word))) != 0, F.lit(False))
    return probed.filter(~maybe).drop(slot, mask, word), probed.filter(maybe).drop(slot, mask, word)


def split_repeated(rows: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose digest is unique for certain, possibly repeated rows)."""
    hashed = F.xxhash64(digest)
    words = filter_words(rows.count(), 2)
    held = written(crowded(rows.select(hashed.alias("hash")), words), "filter")
    return probe(rows, hashed, held, words)


def without(rows: DataFrame, drops: DataFrame, key: str) -> DataFrame:
    """rows LEFT ANTI JOIN drops on a key; only rows that a filter of the
    dropped keys may hold are joined, the others stay where they are."""
    drops = written(drops.select(key).distinct(), "drops")
    hashed = F.xxhash64(key)
    words = filter_words(drops.count(), 64)
    stay, maybe = probe(rows, hashed, marks(drops.select(F.pmod(hashed, F.lit(words)).alias("word"))), words)
    return stay.unionByName(maybe.join(drops, key, "left_anti"))


def resolve(rows: DataFrame, key: str) -> DataFrame:
    """exact_dedup for rows that have their text_sha256 already."""
    rows = rows.drop("keep_id", "group_size", "kept")
    number, first, keep, hidden = (unused(rows, name) for name in ("number", "first", "keep_number", "keep_key"))
    rows = written(rows.withColumn(number, F.monotonically_increasing_id()), "numbered")
    alone, repeated = split_repeated(rows, "text_sha256")
    alone = alone.withColumns({"keep_id": F.col(key), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}).drop(number)
    least = F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(number).alias("r")))
    groups = repeated.groupBy("text_sha256").agg(least.alias(first), F.count("*").alias("group_size"))
    groups = written(groups.select("text_sha256", F.col(first)["k"].alias(hidden), F.col(first)["r"].alias(keep), "group_size"), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    settled = join_groups(repeated, groups, "text_sha256", "group_size", total)
    settled = settled.withColumn("kept", F.col(number) == F.col(keep)).withColumnRenamed(hidden, "keep_id").drop(number, keep)
    return alone.unionByName(settled)


def keep_first(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df without the rows that repeat another's text; df's columns."""
    doc = unused(df, "doc")
    rows = df.select(F.struct(*df.columns).alias(doc), F.col(key).alias(f"{doc}_key"), F.col(text).alias(f"{doc}_text"))
    rows = rows.withColumn("text_sha256", F.sha2(normalised(F.col(f"{doc}_text")).cast("binary"), 256)).drop(f"{doc}_text")
    return resolve(rows, f"{doc}_key").filter("kept").select(f"{doc}.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
