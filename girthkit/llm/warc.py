"""WARC archives: writing with revisit records, reading by boundary chains.

Reading works on byte blocks of any size. A task lists in its block every
candidate record (the magic at any place with a parsable header) with the
offset where its successor must begin. Within a block the candidates are
already linked, so a candidate is shortened to the offset at which its chain
leaves the block. Between blocks, pointer jumping from the file start (offset
0) doubles the distance each round, over one small row a candidate: what it
reaches is an entry of its block. Only records on the chain from an entry are
read; magic inside a payload is never reached, as no chain leads to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_groups, local_path, written
from .dedup import split_repeated

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
#: Bytes of a block, and the most bytes that a record's header may have.
BLOCK = 8 << 20
HEADER = 64 << 10


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column. Five hex digits are 20
    bits, four base32 characters."""
    hexed = F.sha1(data)
    part = lambda g: F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
    letter = lambda g, k: F.expr("'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'").substr((F.shiftright(part(g), 15 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    return F.concat(*[letter(g, k) for g in range(8) for k in range(4)])


def with_revisits(df: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """df with payload_bytes, payload_digest, record_type and refers_to. Of
    rows with equal payloads of min_bytes or more, that with the largest key
    is the response (all that have it, should it be repeated); a null key is
    smaller than any other, and rows without any key are all responses.
    Payloads that occur once stay where they are: only rows
    that a Bloom filter holds for repeated move."""
    df = df.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": base32_sha1(F.col(payload))})
    alone, repeated = split_repeated(df.filter(F.col("payload_bytes") >= min_bytes), "payload_digest")
    small = df.filter(F.col("payload_bytes") < min_bytes)
    narrow = written(repeated.select(key, "payload_digest"), "repeated")
    groups = written(narrow.groupBy("payload_digest").agg(F.max(key).alias("_last"), F.count("*").alias("_n")), "groups")
    settled = join_groups(repeated, groups, "payload_digest", "_n", narrow.count()).drop("_n")
    alone = alone.unionByName(small) if min_bytes > 0 else alone
    df = settled.unionByName(alone.withColumn("_last", F.lit(None).cast(df.schema[key].dataType)))
    df = df.withColumn("refers_to", F.when(F.col(key).isNull() | (F.col(key) < F.col("_last")), F.col("_last"))).drop("_last")
    return df.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write_warc(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "payload") -> None:
    """One archive a partition, one record a row, by Spark's own committed
    text writer (a record is a row; the two line ends after it are the line
    separator). A revisit has no body; WARC-Payload-Length keeps its size."""
    crlf = "\r\n"
    clean = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(crlf + crlf))
    body = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col(payload).cast("string")))
    head = F.concat(
        F.lit(f"{MAGIC.decode()}WARC-Type: "), F.col("record_type"),
        F.lit(f"{crlf}WARC-Record-ID: <urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(">"),
        F.lit(f"{crlf}WARC-Date: 2024-01-01T00:00:00Z{crlf}WARC-Target-URI: "), clean,
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{crlf}WARC-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{crlf}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "),
        F.octet_length(F.col("_body")).cast("string"), F.lit(crlf + crlf),
    )
    df.withColumn("_body", body).select(F.concat(head, F.col("_body")).alias("value")).write.option("lineSep", END.decode()).text(path)


def _header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The fields of the header at a place, and the place of the body; None if
    it isn't a header with a length."""
    stop = data.find(END, at, at + HEADER)
    if stop < 0 or not data.startswith(MAGIC, at):
        return None
    fields = {}
    for line in data[at + len(MAGIC) : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        return None
    return fields, stop + len(END)


def _read(path: str, start: int, length: int) -> bytes:
    system, name = local_path(path)
    with system.open_input_file(name) as file:
        file.seek(start)
        return file.read(length)


def _candidates(rows: Iterator, block: int) -> Iterator:
    import pandas as pd

    for frame in rows:
        for path, size, start in frame[["path", "size", "start"]].itertuples(index=False):
            stop = min(start + block, size)
            data = _read(path, start, min(stop + HEADER, size) - start)
            links, at = [], data.find(MAGIC)
            while 0 <= at < stop - start:
                if (head := _header(data, at)) is not None:
                    links.append((start + at, start + head[1] + int(head[0]["content-length"]) + len(END)))
                at = data.find(MAGIC, at + 1)
            leaves: dict[int, int] = {}
            for offset, after in reversed(links):  # the later ones are settled first
                leaves[offset] = leaves.get(after, after) if after < stop else after
            yield pd.DataFrame({"path": path, "at": list(leaves), "next": [x for x in leaves.values()]}).astype({"at": "int64", "next": "int64"})


def _records(rows: Iterator, size_of_block: int) -> Iterator:
    import base64
    import hashlib

    import pandas as pd

    columns = ["path", "at", "record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length", "payload", "digest_ok"]
    for frame in rows:
        for path, size, entry in frame[["path", "size", "entry"]].itertuples(index=False):
            found, held = [], 0
            stop, at = min((entry // size_of_block + 1) * size_of_block, size), entry
            data, base = _read(path, entry, min(stop + HEADER, size) - entry), entry
            while at < stop:
                head = _header(data, at - base)
                if head is None:
                    raise ValueError(f"{path}: no record at {at}")
                fields, body = head
                length = int(fields["content-length"])
                block = data[body : body + length] if body + length <= len(data) else _read(path, base + body, length)
                if len(block) < length:
                    raise ValueError(f"{path}: the record at {at} is cut short")
                payload, digest = block.partition(END)[2] if "application/http" in fields.get("content-type", "") else block, fields.get("warc-payload-digest", "")
                revisit = fields.get("warc-type") == "revisit"
                own = None if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                found.append((path, at, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest.removeprefix("sha1:"), int(fields.get("warc-payload-length", len(payload))), None if revisit else payload, revisit or "sha1:" + own == digest))
                held += length
                at = base + body + length + len(END)
                if held > size_of_block:
                    yield pd.DataFrame(found, columns=columns)
                    found, held = [], 0
            if found:
                yield pd.DataFrame(found, columns=columns)


RECORD = "path string, at long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary, digest_ok boolean"


def read_warc(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The records of every file in a folder (hidden ones apart). Empty files
    have none; a broken chain is an error that names the file and offset.
    Files are listed, cut into blocks and followed as tables."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", F.col("length").alias("size"))
    files = written(files, "files")
    number, largest = files.agg(F.sum(F.ceil(F.col("size") / block)), F.max("size")).first()
    if not number:
        return spark.createDataFrame([], RECORD)
    tasks = min(number, max(4 * spark.sparkContext.defaultParallelism, number // 16))
    blocks = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))))
    blocks = blocks.repartition(tasks, "path", "start")
    links = written(blocks.mapInPandas(partial(_candidates, block=block), "path string, at long, next long"), "links")
    # pointer jumping: `reached` are block entries, `links` jump 2^k blocks
    reached = files.withColumn("at", F.lit(0).cast("long"))
    for _ in range(max(1, (largest // block + 1).bit_length())):
        hop = links.select("path", "at", "next")
        ahead = reached.join(hop, ["path", "at"]).select("path", "size", F.col("next").alias("at")).filter("at < size")
        reached = written(reached.union(ahead).distinct(), "reached")
        onward = links.select("path", F.col("at").alias("next"), F.col("next").alias("_n"))
        links = written(links.join(onward, ["path", "next"], "left").select("path", "at", F.coalesce("_n", "next").alias("next")), "links")
    entries = reached.select("path", "size", F.col("at").alias("entry")).repartition(tasks, "path", "entry")
    return entries.mapInPandas(partial(_records, size_of_block=block), RECORD)


def archive(pages: DataFrame, min_bytes: int = 0, block: int = BLOCK) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives in the shared folder,
    read them back, and return what the records say. Null html counts as
    empty; null and repeated ids are records of their own, as with_revisits
    has them; an empty table gives no rows."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    path = fresh_path(spark, "warc")
    write_warc(with_revisits(rows, "page_id", "payload", min_bytes), path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    got = read_warc(spark, path, block)
    bad = F.when(~F.col("digest_ok"), F.raise_error(F.concat(F.lit("digest differs: "), "record_id")).cast("string"))
    return got.select(
        number(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.coalesce(bad, F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to").isNotNull(), number(F.col("refers_to"))).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hexed FROM p),
d AS (SELECT page_id, payload_bytes, hexed,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + (CAST('0x' || substr(hexed, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) % 32 AS INT), 1)), 'string_agg', '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest)
"""
