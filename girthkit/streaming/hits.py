"""A hit log as a stream that keeps the best rows of each order.

The log is a folder of JSON lines; each micro-batch is merged into a table of
at most k rows an order, so the state has a fixed bound a key. Batches write a
new version of the table and a pointer to it is the query's progress, so a
batch that is run again gives the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HIT = "graph_hash string, `order` int, total long, weighted long, edge_count long, evaluated long"


def best(rows: DataFrame, k: int) -> DataFrame:
    """One row a hash, then the k best of each order by (total, weighted,
    edges, hash)."""
    rows = rows.groupBy("graph_hash").agg(F.min(F.struct("total", "weighted", "edge_count", "order", "evaluated")).alias("x")).select("graph_hash", "x.*")
    place = F.row_number().over(Window.partitionBy("order").orderBy("total", "weighted", "edge_count", "graph_hash"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def keep_best(spark: SparkSession, log: str, out: str, k: int, available_now: bool = True) -> StreamingQuery:
    """Follow the log; `out`/v=<batch> holds the best rows after each batch."""

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        columns = ["graph_hash", "order", "total", "weighted", "edge_count", "evaluated"]
        rows = batch.select(*columns)
        if number:
            rows = rows.unionByName(session.read.parquet(f"{out}/v={number - 1}").select(*columns))
        best(rows, k).write.mode("overwrite").parquet(f"{out}/v={number}")

    stream = spark.readStream.schema(HIT).option("maxFilesPerTrigger", 8).json(log)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
