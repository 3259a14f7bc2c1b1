"""Queries on isomorphism, deduplication, walks, generators and fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girthkit.functions.scalar import graph_hash
from girthkit.operators import cycles as K
from girthkit.operators import graphs as G
from girthkit.operators import iso as I
from girthkit.plans.primitives import OK
from girthkit.plans.registry import query
from girthkit.sources import corpus as C

RING, ADJ = C.RING_SQL, C.ADJ_SQL


def _wl_sql() -> str:
    out = "l0 AS (SELECT p.gid, CAST(p.a AS INT) u, CAST(count(a.v) AS VARCHAR) x FROM pts p LEFT JOIN adj a ON a.gid = p.gid AND a.u = p.a GROUP BY ALL)"
    for k in range(4):
        out += f",\nl{k + 1} AS (SELECT l.gid, l.u, sha256(any_value(l.x) || '|' || coalesce(string_agg(m.x, ',' ORDER BY m.x), '')) x FROM l{k} l LEFT JOIN adj a ON a.gid = l.gid AND a.u = l.u LEFT JOIN l{k} m ON m.gid = a.gid AND m.u = a.v GROUP BY l.gid, l.u)"
    return out


@query(f"WITH {RING}, {ADJ}, {_wl_sql()} SELECT gid, sha256(string_agg(x, ',' ORDER BY x)) wl FROM l4 GROUP BY gid")
def wl_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.wl_hash(C.ring(spark, sf_dir))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admissible ring graphs and a renamed copy of each, so that there
    are classes of several members."""
    e = G.admissible_edges(C.ring(spark, sf_dir)).persist()
    turn = lambda x: ((F.col(x) * (F.col("n") - 1) + 3) % F.col("n")).cast("int")
    other = e.select((F.col("gid") + 1_000_000_000).alias("gid"), "n", turn("u").alias("a"), turn("v").alias("b"))
    return e.unionByName(C.normalise(other)).persist()


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = copies(spark, sf_dir)
    bucket = e.groupBy("gid", "n").agg(F.count("*").alias("m")).join(I.wl_hash(e), "gid").select("gid", F.concat_ws("-", "n", "m", F.substring("wl", 1, 24)).alias("bucket"))
    return I.classes(e, bucket)


@query()
def iso_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir)


@query()
def iso_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by size, and how many graphs a class stands for."""
    sizes = _classes(spark, sf_dir).groupBy("representative").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("classes"), F.sum("size").alias("graphs"))


@query(f"WITH {RING}, k AS (SELECT gid, any_value(n) n, sha256(string_agg(u || '-' || v, ',' ORDER BY u, v) FILTER (WHERE v < 4)) h FROM e GROUP BY gid) SELECT gid, h FROM k WHERE h IS NULL UNION ALL SELECT min(gid), h FROM k WHERE h IS NOT NULL GROUP BY h")
def dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First graph of each hash (here of the edges among vertices 0 to 3, so
    that hashes repeat); a graph without one stays."""
    e = C.ring(spark, sf_dir)
    part = F.array_sort(F.collect_list(F.when(F.col("v") < 4, F.struct("u", "v"))))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["u"].cast("string"), F.lit("-"), x["v"].cast("string"))), ",")
    rows = e.groupBy("gid").agg(part.alias("p")).select("gid", F.when(F.size("p") > 0, F.sha2(text.cast("binary"), 256)).alias("h"))
    return G.keep_first(rows, "h", "gid")


@query(f"WITH {RING}, {C.HASH_SQL}, k AS (SELECT gid, substr(graph_hash, 1, 3) h FROM hashes), pool AS (SELECT DISTINCT h FROM k WHERE gid % 3 = 0) SELECT k.gid FROM k WHERE gid % 3 <> 0 AND h NOT IN (SELECT h FROM pool)")
def dedup_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose (short) hash the pool does not have."""
    rows = G.hashed(C.ring(spark, sf_dir)).select("gid", F.substring("graph_hash", 1, 3).alias("h"))
    return rows.filter("gid % 3 <> 0").join(rows.filter("gid % 3 = 0").select("h"), "h", "left_anti").select("gid")


@query()
def legal_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legal walk of 24 steps from every admissible graph."""
    moved = I.legal_walks(G.admissible_edges(C.ring(spark, sf_dir)), 24, 5)
    return moved.select("gid", "n", F.size("edges").alias("m"), graph_hash(F.col("edges"), F.col("n")).alias("graph_hash"))


@query()
def corpus_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 distinct admissible graphs of seeded attempts."""
    return I.distinct_graphs(spark, 200, 401, 10, 13)


@query()
def seed_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cubic (odd orders: nearly cubic) legal seed of each order 10 to 20."""
    import random

    import pandas as pd

    def make(frames):
        for frame in frames:
            rows = []
            for n in frame["id"].tolist():
                draw, near = random.Random(I.attempt_seed(7, n)), None
                while near is None or not I.legal(near):
                    near = I.random_regular(n, 3, draw) if n % 2 == 0 else I.random_degrees(n, 3, 4, draw)
                rows.append((n, I.edges_of(near)))
            yield pd.DataFrame(rows, columns=["n", "edges"])

    made = spark.range(10, 21).mapInPandas(make, "n int, edges array<struct<u:int,v:int>>")
    return made.select("n", F.size("edges").alias("m"), graph_hash(F.col("edges"), F.col("n")).alias("graph_hash"))


# The edges of a cubic graph on 24 vertices without cycles of
# length 4 and 8.
MARKSTROM = (
    (0, 1), (0, 8), (0, 9), (1, 2), (1, 11), (2, 3), (2, 11), (3, 4), (3, 12), (4, 5), (4, 14), (5, 6), (5, 14),
    (6, 7), (6, 15), (7, 8), (7, 17), (8, 17), (9, 10), (9, 18), (10, 11), (10, 18), (12, 13), (12, 19), (13, 14),
    (13, 19), (15, 16), (15, 20), (16, 17), (16, 20), (18, 21), (19, 22), (20, 23), (21, 22), (21, 23), (22, 23),
)


def markstrom(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(24, 24, u, v) for u, v in MARKSTROM], "gid long, n int, u int, v int")


@query("SELECT * FROM (VALUES (3, 7), (4, 0), (8, 0), (16, 228)) t(length, observed)")
def fixture_markstroem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle counts of the fixed graph, held against its known ones."""
    return K.count_cycles(markstrom(spark), (3, 4, 8, 16)).select("length", "observed")
