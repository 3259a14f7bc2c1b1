"""Queries on the catalog: workspaces (customers), corpora (orders), lines and
evaluations (line items), as derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girthkit.operators import graphs as G
from girthkit.plans.registry import query
from girthkit.sources import corpus as C

#: A line is an order: its workspace the customer, its hash from its key.
LINES = "lines AS (SELECT o_custkey workspace, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') created_at, sha256('line' || o_orderkey) line_hash, o_orderkey FROM orders)"
MEMBERS = "members AS (SELECT sha256('line' || l_orderkey) line_hash, l_linenumber AS position, (l_partkey * 7 + l_suppkey) % 4000 gid, sum(1) OVER (PARTITION BY 1) total FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("workspace"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.sha2(F.concat(F.lit("line"), F.col("o_orderkey").cast("string")).cast("binary"), 256).alias("line_hash"), "o_orderkey")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = C.read(spark, sf_dir, "lineitem")
    return li.select(F.sha2(F.concat(F.lit("line"), F.col("l_orderkey").cast("string")).cast("binary"), 256).alias("line_hash"), F.col("l_linenumber").alias("position"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 4000).alias("gid"))


def newest() -> Window:
    return Window.partitionBy("workspace").orderBy(F.desc("created_at"), F.desc("line_hash"))


@query(f"WITH {LINES} SELECT workspace, line_hash FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY created_at DESC, line_hash DESC) r FROM lines) WHERE r = 1")
def latest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest line of a workspace; of equal times the larger hash."""
    return lines(spark, sf_dir).withColumn("r", F.row_number().over(newest())).filter("r = 1").select("workspace", "line_hash")


@query(f"WITH {LINES} SELECT workspace, line_hash, created_at, row_number() OVER (PARTITION BY workspace ORDER BY created_at DESC, line_hash DESC) = 1 latest FROM lines")
def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("workspace", "line_hash", "created_at", (F.row_number().over(newest()) == 1).alias("latest"))


@query("SELECT l_orderkey line, l_returnflag baseline, l_linenumber evaluation FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) r FROM lineitem) WHERE r = 1")
def latest_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest evaluation of each line by each baseline."""
    li = C.read(spark, sf_dir, "lineitem")
    r = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy(F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_partkey")))
    return li.withColumn("r", r).filter("r = 1").select(F.col("l_orderkey").alias("line"), F.col("l_returnflag").alias("baseline"), F.col("l_linenumber").alias("evaluation"))


@query(f"WITH {LINES}, k AS (SELECT workspace, count(*) lines, min(created_at) first_at FROM lines GROUP BY workspace) SELECT c_custkey workspace, c_name, coalesce(lines, 0) lines, first_at FROM customer LEFT JOIN k ON k.workspace = c_custkey")
def workspace_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every workspace with its counts, those without lines too."""
    k = lines(spark, sf_dir).groupBy("workspace").agg(F.count("*").alias("lines"), F.min("created_at").alias("first_at"))
    ws = C.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace"), "c_name")
    return ws.join(k, "workspace", "left").select("workspace", "c_name", F.coalesce("lines", F.lit(0)).alias("lines"), "first_at")


@query(f"WITH {C.RING_SQL}, {C.HASH_SQL}, {MEMBERS} SELECT line_hash, position, members.gid, graph_hash FROM members JOIN hashes ON hashes.gid = members.gid")
def line_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of lines with their graphs, by position."""
    graphs = G.hashed(C.ring(spark, sf_dir)).select("gid", "graph_hash")
    return members(spark, sf_dir).join(graphs, "gid").select("line_hash", "position", "gid", "graph_hash")


@query(f"WITH {C.RING_SQL}, {MEMBERS} SELECT DISTINCT gid FROM members WHERE gid NOT IN (SELECT gid FROM gn)")
def membership_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that the corpus lacks."""
    return members(spark, sf_dir).select("gid").distinct().join(C.ring(spark, sf_dir).select("gid"), "gid", "left_anti")


@query(f"WITH {LINES}, p AS (SELECT DISTINCT substr(sha256('line' || (c_custkey * 5)), 1, 4) prefix FROM customer), k AS (SELECT prefix, count(line_hash) hits, min(line_hash) one FROM p LEFT JOIN lines ON starts_with(line_hash, prefix) GROUP BY prefix) SELECT prefix, CASE WHEN hits = 0 THEN 'not found' WHEN hits > 1 THEN 'ambiguous' ELSE one END result FROM k")
def resolve_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of hashes to lines; all prefixes have one length, so the match
    is an equi-join."""
    wanted = C.read(spark, sf_dir, "customer").select(F.substring(F.sha2(F.concat(F.lit("line"), (F.col("c_custkey") * 5).cast("string")).cast("binary"), 256), 1, 4).alias("prefix")).distinct()
    known = lines(spark, sf_dir).select(F.substring("line_hash", 1, 4).alias("prefix"), "line_hash")
    k = wanted.join(known, "prefix", "left").groupBy("prefix").agg(F.count("line_hash").alias("hits"), F.min("line_hash").alias("one"))
    return k.select("prefix", F.when(F.col("hits") == 0, "not found").when(F.col("hits") > 1, "ambiguous").otherwise(F.col("one")).alias("result"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT -l_orderkey - 1 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def index_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the index or the files lack (the latter as -key - 1)."""
    index = C.read(spark, sf_dir, "orders").select("o_orderkey")
    files = C.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return index.join(files, "o_orderkey", "left_anti").union(files.join(index, "o_orderkey", "left_anti").select(-F.col("o_orderkey") - 1))


@query("SELECT 'workspaces' name, count(*) k FROM customer UNION ALL SELECT 'lines', count(*) FROM orders UNION ALL SELECT 'line_graphs', count(*) FROM lineitem UNION ALL SELECT 'graphs', count(DISTINCT l_orderkey // 5) FROM lineitem")
def reindex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the derived tables after a rebuild."""
    count = lambda df, name: df.agg(F.count("*").alias("k")).select(F.lit(name).alias("name"), "k")
    read = lambda name: C.read(spark, sf_dir, name)
    graphs = read("lineitem").select(F.expr("l_orderkey div 5")).distinct()
    return count(read("customer"), "workspaces").union(count(read("orders"), "lines")).union(count(read("lineitem"), "line_graphs")).union(count(graphs, "graphs"))
