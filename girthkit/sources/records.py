"""Records as files hold them: JSON-lines corpora, score layouts, graph6."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girthkit.functions.scalar import edge, graph_hash
from girthkit.session import shared_folder

RECORD = "edges array<array<int>>, graph_hash string, `order` int"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_graphs(graphs: DataFrame, path: str) -> None:
    """Graphs (n, edges, graph_hash) as compressed JSON lines, keys sorted."""
    pairs = F.transform("edges", lambda e: F.array(e["u"], e["v"]))
    graphs.select(pairs.alias("edges"), "graph_hash", F.col("n").alias("order")).write.option("compression", "gzip").json(path)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Graphs of a corpus; a hash that differs from the edges' is an error."""
    rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    edges = F.transform("edges", lambda p: F.struct(p[0].alias("u"), p[1].alias("v")))
    good = graph_hash(edges, F.col("order")) == F.col("graph_hash")
    checked = F.when(good, F.col("graph_hash")).otherwise(F.raise_error(F.concat(F.lit("hash differs: "), "graph_hash")).cast("string"))
    return rows.select(edges.alias("edges"), "order", checked.alias("graph_hash"))


def _components(json: Column) -> Column:
    """Length -> text of a component, from either layout."""
    text = F.coalesce(F.get_json_object(json, "$.components"), F.get_json_object(json, "$.score.components"))
    return F.from_json(text, "map<string,string>")


def _observed(value: Column) -> Column:
    return F.coalesce(value.try_cast("long"), F.get_json_object(value, "$.observed").try_cast("long"))


def profiles(records: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """records (gid, json) with `profile`, null if a length is missing."""
    parts = [_observed(F.element_at("c", F.lit(str(x)))).cast("string") for x in lengths]
    return records.withColumn("c", _components(F.col("json"))).withColumn("profile", F.concat(F.lit("("), *[y for p in parts for y in (p, F.lit(","))][:-1], F.lit(")")))


def totals(records: DataFrame) -> DataFrame:
    """records with `total`, null unless every component is exact; a bare
    integer is exact."""
    rows = records.withColumn("v", F.map_values(_components(F.col("json"))))
    exact = F.forall("v", lambda x: F.coalesce(F.get_json_object(x, "$.status"), F.lit("EXACT")) == "EXACT")
    total = F.aggregate(F.transform("v", _observed), F.lit(0).cast("long"), lambda t, x: t + x)
    return rows.withColumn("total", F.when(exact, total))


def normalised(raw: DataFrame) -> DataFrame:
    """(gid, pairs) -> (gid, n, edges): no loops, no repeats, sorted."""
    n = F.array_max(F.flatten("pairs")) + 1
    ends = F.transform(F.filter("pairs", lambda p: p[0] != p[1]), lambda p: edge(p[0], p[1]))
    return raw.select("gid", n.cast("int").alias("n"), F.array_sort(F.array_distinct(ends)).alias("edges"))


def to_graph6(edges: DataFrame) -> DataFrame:
    """Edges -> (gid, line): order and upper triangle by columns, six bits a
    character, orders up to 62."""
    bits = edges.groupBy("gid", "n").agg(F.collect_set(F.expr("v * (v - 1) div 2 + u")).alias("at"))
    chars = F.transform(F.sequence(F.lit(0), F.expr("cast((n * (n - 1) div 2 + 5) div 6 - 1 AS int)")), lambda c: F.char(F.lit(63) + sum((F.when(F.array_contains("at", (c * 6 + k).cast("long")), 32 >> k).otherwise(0) for k in range(6)), F.lit(0))))
    return bits.select("gid", F.concat(F.char(F.col("n") + 63), F.array_join(chars, "")).alias("line"))


def from_graph6(lines: DataFrame) -> DataFrame:
    """(gid, line) -> edges. A header is dropped; a line that is too short for
    its order is an error."""
    body = F.regexp_replace("line", "^>>graph6<<", "")
    rows = lines.select("gid", body.alias("line")).withColumn("n", F.ascii("line") - 63)
    need = F.expr("(n * (n - 1) div 2 + 5) div 6 + 1")
    rows = rows.withColumn("line", F.when(F.length("line") >= need, F.col("line")).otherwise(F.raise_error(F.lit("graph6 line is cut short")).cast("string")))
    rows = rows.select("gid", "n", "line", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("v"))
    rows = rows.select("gid", "n", "line", "v", F.explode(F.sequence(F.lit(0), F.col("v") - 1)).alias("u"))
    rows = rows.withColumn("k", F.expr("cast(v * (v - 1) div 2 + u AS int)"))
    on = F.expr("getbit(ascii(substr(line, 2 + k div 6, 1)) - 63, 5 - k % 6) = 1")
    return rows.filter(on).select("gid", F.col("n").cast("int"), F.col("u").cast("int"), F.col("v").cast("int"))
