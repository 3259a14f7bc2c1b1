"""Graph corpora as DataFrames, derived from the relational tables.

Long form: one row an edge, (gid, n, u, v) with u < v. Nested form: one row a
graph, (gid, n, edges).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalise(pairs: DataFrame) -> DataFrame:
    """(gid, n, a, b) in any direction, with loops and repeats -> edges."""
    return pairs.filter("a <> b").select("gid", "n", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _chords(lineitem: DataFrame, per_graph: int, low: int, span: int) -> DataFrame:
    gid = F.expr(f"l_orderkey div {per_graph}")
    n = (F.lit(low) + gid % span).cast("int")
    raw = lineitem.select(gid.alias("gid"), n.alias("n"), "l_partkey", "l_suppkey", "l_linenumber")
    return raw.select("gid", "n", ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % F.col("n")).cast("int").alias("a"), ((F.col("l_suppkey") * 13 + F.col("l_partkey")) % F.col("n")).cast("int").alias("b"))


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected graphs of order 12 to 24: a ring and chords from line items."""
    chords = _chords(read(spark, sf_dir, "lineitem"), 5, 12, 13)
    corners = chords.select("gid", "n").distinct().select("gid", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"))
    return normalise(corners.withColumn("b", (F.col("a") + 1) % F.col("n")).unionByName(chords))


def graph_bits(pairs: DataFrame, most: int, start: list[Column] | None = None) -> DataFrame:
    """(gid, n, a, b) in any direction, with loops and repeats -> one row a
    graph, (gid, n, w0, w1, ..): edge u < v is bit v * (v - 1) / 2 + u of the
    words. One shuffle of a row a graph and task; ends beyond `most` vertices
    are an error. start: words, of n, that every graph begins with."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    place = F.when((low >= 0) & (high < F.least(F.lit(most), F.col("n"))), high * (high - 1) / 2 + low).otherwise(F.raise_error(F.lit("a vertex beyond the order")).cast("double"))
    bit = F.when(F.col("a") != F.col("b"), place).cast("int")
    words = range(-(-most * (most - 1) // 2 // 64))
    marked = pairs.select("gid", "n", bit.alias("bit"))
    rows = marked.groupBy("gid", "n").agg(*[F.bit_or(F.when(F.expr(f"bit div 64 = {k}"), F.expr("shiftleft(1L, bit % 64)"))).alias(f"w{k}") for k in words])
    full = [F.coalesce(f"w{k}", F.lit(0).cast("long")) for k in words]
    return rows.select("gid", "n", *[(x.bitwiseOR(start[k]) if start else x).alias(f"w{k}") for k, x in enumerate(full)])


def ring_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs of ring() as rows of bits."""
    low, span = 12, 13
    words = []
    for k in range(5):
        of = []
        for n in range(low, low + span):
            ring = sum(1 << max(a, (a + 1) % n) * (max(a, (a + 1) % n) - 1) // 2 + min(a, (a + 1) % n) for a in range(n))
            word = ring >> 64 * k & (1 << 64) - 1
            of.append(F.lit(word - (1 << 64) if word >> 63 else word).cast("long"))
        words.append(F.element_at(F.array(*of), F.col("n") - (low - 1)))
    chords = _chords(read(spark, sf_dir, "lineitem"), 5, low, span)
    return graph_bits(chords.filter("gid IS NOT NULL"), low + span - 1, words)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of order 10 to 24 with a mean degree of about ten."""
    return normalise(_chords(read(spark, sf_dir, "lineitem"), 40, 10, 15))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.unionByName(edges.select("gid", "n", F.col("v").alias("u"), F.col("u").alias("v")))


def nested(edges: DataFrame) -> DataFrame:
    return edges.groupBy("gid", "n").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("edges"))


def vertices(edges: DataFrame) -> DataFrame:
    """Every vertex of every graph, isolated ones too."""
    return edges.select("gid", "n").distinct().select("gid", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("u"))


# The same corpora for the SQL oracle, as chains of common table expressions.
RING_SQL = """raw AS (SELECT l_orderkey // 5 gid, CAST(12 + (l_orderkey // 5) % 13 AS INT) n, l_partkey p, l_suppkey s, l_linenumber ln FROM lineitem),
gn AS (SELECT DISTINCT gid, n FROM raw),
pts AS (SELECT gid, n, CAST(unnest(range(0, n)) AS INT) a FROM gn),
ab AS (SELECT gid, n, a, CAST((a + 1) % n AS INT) b FROM pts
  UNION ALL SELECT gid, n, CAST((p * 7 + ln) % n AS INT), CAST((s * 13 + p) % n AS INT) FROM raw),
e AS (SELECT DISTINCT gid, n, least(a, b) u, greatest(a, b) v FROM ab WHERE a <> b)"""
DENSE_SQL = """m AS (SELECT l_orderkey // 40 gid, 10 + CAST((l_orderkey // 40) % 15 AS INT) n, l_partkey p, l_suppkey s, l_linenumber ln FROM lineitem),
ab AS (SELECT gid, n, CAST((p * 7 + ln) % n AS INT) a, CAST((s * 13 + p) % n AS INT) b FROM m),
e AS (SELECT DISTINCT gid, n, least(a, b) u, greatest(a, b) v FROM ab WHERE a <> b),
gn AS (SELECT DISTINCT gid, n FROM e)"""
ADJ_SQL = "adj AS (SELECT gid, n, u, v FROM e UNION ALL SELECT gid, n, v, u FROM e)"
DEG_SQL = "deg AS (SELECT g.gid, g.n, CAST(g.u AS INT) u, count(a.v) d FROM (SELECT gid, n, unnest(range(0, n)) u FROM gn) g LEFT JOIN adj a ON a.gid = g.gid AND a.u = g.u GROUP BY ALL)"
C4_SQL = """c4t AS (SELECT gid, CAST(sum(k * (k - 1) // 2) // 2 AS BIGINT) c4 FROM (
  SELECT x.gid, x.u, y.u w, count(*) k FROM adj x JOIN adj y ON x.gid = y.gid AND x.v = y.v AND x.u < y.u GROUP BY ALL) GROUP BY gid)"""
C3_SQL = """c3t AS (SELECT x.gid, count(*) c3 FROM e x JOIN e y ON x.gid = y.gid AND x.v = y.u JOIN e z ON z.gid = x.gid AND z.u = x.u AND z.v = y.v GROUP BY x.gid)"""
HASH_SQL = """hashes AS (SELECT gid, sha256('{"edges":[' || string_agg('[' || u || ',' || v || ']', ',' ORDER BY u, v) || '],"order":' || any_value(n) || '}' || chr(10)) graph_hash FROM e GROUP BY gid)"""
