"""What several operators of this folder share: the shared folder, written
tables, joins that survive hot keys, and distributed connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girthkit.session import shared_folder

#: ASCII white space, as every contract of this folder counts it.
SPACE = r"[\x20\x09-\x0D]+"

#: A key with at least total/HEAVY rows is heavy, so there are at most HEAVY
#: of them and a broadcast of the heavy keys has a fixed bound.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return shared_folder(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> SparkSession:
    """Rows of texts go to Python by the thousand, unless the session asks for
    fewer: ten thousand long texts at once are a lot of memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > 1000:
        spark.conf.set(name, "1000")
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives
    lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written_path(df: DataFrame) -> str:
    """The folder of a table that written() made."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def local_path(path: str) -> tuple[object, str]:
    """(pyarrow filesystem, path in it) of a URI of the shared folder, for
    tasks that read byte ranges or single partitions of a written table."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows LEFT JOIN groups ON key, where groups has one row a key and the
    number of rows it stands for in `size`. Keys with a thousandth of all
    rows or more are joined by a broadcast of at most HEAVY rows, so a hot key
    stays in the tasks that hold its rows; the rest shuffles."""
    least = max(total // HEAVY, 2)
    hit = F.col(size) >= least
    heavy = groups.filter(hit)
    light = groups.filter(~hit)
    flag = unused(rows, "heavy")
    names = heavy.select(key, F.lit(True).alias(flag))
    marked = rows.join(F.broadcast(names), key, "left")
    hot = marked.filter(F.col(flag)).drop(flag).join(F.broadcast(heavy), key)
    cold = marked.filter(F.col(flag).isNull()).drop(flag).join(light, key, "left")
    return hot.unionByName(cold)


def settle_driver(spark: SparkSession) -> None:
    """Let go of what finished queries hold: the driver's plans, task records
    and broadcasts (with them their blocks on executors) go with a collection,
    and freed memory goes back to the system."""
    import gc

    from .words import release

    gc.collect()
    spark._jvm.System.gc()
    release()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, root): root is the smallest node that links
    reach. Alternates the large-star and small-star steps, whose map side
    keeps a hub's neighbours spread over tasks; every round is written to the
    shared folder. Ends when a round changes nothing."""
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    last = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node joins the smallest
        both = now.union(now.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour of a node, and it, join the smallest
        large = large.filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        step = written(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        sign = tuple(step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        delete(spark, written_path(now)) if now.inputFiles() else None
        now = step
        settle_driver(spark)
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
