"""Queries on records as files hold them: nested scores, raw edge lists,
graph6 lines. The records are derived from the corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girthkit.operators import graphs as G
from girthkit.plans.registry import query
from girthkit.plans.scoring import CAP, SCORED, scored
from girthkit.sources import corpus as C
from girthkit.sources import records as R


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, json): even graphs have integer components at the top, odd ones
    observed counts with a status within a score; some lack the second length."""
    s = scored(spark, sf_dir)
    four, eight = F.col("c4").cast("string"), F.col("c8").cast("string")
    flat = F.concat(F.lit('{"components":{"4":'), four, F.when(F.col("gid") % 5 != 0, F.concat(F.lit(',"8":'), eight)).otherwise(F.lit("")), F.lit("}}"))
    state = lambda x: F.when(x >= CAP, "SATURATED_AT_CAP").otherwise("EXACT")
    deep = F.concat(F.lit('{"score":{"components":{"4":{"observed":'), four, F.lit(',"status":"'), state(F.col("c4")), F.lit('"},"8":{"observed":'), eight, F.lit(',"status":"'), state(F.col("c8")), F.lit('"}}}}'))
    return s.select("gid", F.when(F.col("gid") % 2 == 0, flat).otherwise(deep).alias("json"))


PROFILE = SCORED + ", pf AS (SELECT gid, CASE WHEN gid % 2 = 0 AND gid % 5 = 0 THEN NULL ELSE '(' || c4 || ',' || c8 || ')' END profile, c4, c8 FROM sc)"


@query(PROFILE + " SELECT gid, profile FROM pf")
def profile_from_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of either layout; null if a length is missing."""
    return R.profiles(hits(spark, sf_dir), (4, 8)).select("gid", "profile")


@query(PROFILE + " SELECT gid FROM pf WHERE profile IN ('(2,22)', '(5,50)', '(5,65)', '(7,45)')")
def profile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profiles(hits(spark, sf_dir), (4, 8)).filter(F.col("profile").isin("(2,22)", "(5,50)", "(5,65)", "(7,45)")).select("gid")


@query(PROFILE + " SELECT gid, CASE WHEN gid % 2 = 0 THEN c4 + CASE WHEN gid % 5 = 0 THEN 0 ELSE c8 END WHEN c4 < 64 AND c8 < 64 THEN c4 + c8 END total FROM pf")
def exact_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the components; null unless every status is EXACT."""
    return R.totals(hits(spark, sf_dir)).select("gid", "total")


@query(SCORED + " SELECT n, gid seed FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY CASE WHEN gid % 3 = 0 THEN NULL ELSE total END NULLS LAST, weighted, m, gid) r FROM sc) WHERE r = 1")
def best_seed_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best start of each order; unknown totals come last."""
    known = F.when(F.col("gid") % 3 != 0, F.col("total"))
    r = F.row_number().over(Window.partitionBy("n").orderBy(known.asc_nulls_last(), "weighted", "m", "gid"))
    return scored(spark, sf_dir).withColumn("r", r).filter("r = 1").select("n", F.col("gid").alias("seed"))


RAW = C.RING_SQL.split("pts AS")[0].rstrip().rstrip(",")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, pairs) as they come: directed, with loops and repeats."""
    raw = C._chords(C.read(spark, sf_dir, "lineitem"), 5, 12, 13)
    return raw.groupBy("gid").agg(F.collect_list(F.array("a", "b")).alias("pairs"))


@query(f"WITH {RAW}, p AS (SELECT gid, CAST((p * 7 + ln) % n AS INT) a, CAST((s * 13 + p) % n AS INT) b FROM raw), d AS (SELECT DISTINCT gid, least(a, b) u, greatest(a, b) v FROM p WHERE a <> b), o AS (SELECT gid, max(greatest(a, b)) + 1 n FROM p GROUP BY gid) SELECT o.gid, o.n, coalesce(string_agg(u || '-' || v, ',' ORDER BY u, v), '') edges FROM o LEFT JOIN d ON d.gid = o.gid GROUP BY o.gid, o.n")
def normalize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pairs to sorted distinct edges, the order from the largest vertex."""
    rows = R.normalised(raw_edges(spark, sf_dir))
    return rows.select("gid", "n", F.array_join(F.transform("edges", lambda e: F.concat(e["u"].cast("string"), F.lit("-"), e["v"].cast("string"))), ",").alias("edges"))


@query(f"WITH {RAW}, p AS (SELECT gid, CAST((p * 7 + ln) % n AS INT) a, CAST((s * 13 + p) % n AS INT) b FROM raw) SELECT gid, count(*) FILTER (WHERE a = b) = 0 AND count(*) = count(DISTINCT least(a, b) * 64 + greatest(a, b)) legal FROM p GROUP BY gid")
def legal_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether raw pairs have no loops and no repeats, as they come."""
    ends = F.transform("pairs", lambda p: F.least(p[0], p[1]) * 64 + F.greatest(p[0], p[1]))
    return raw_edges(spark, sf_dir).select("gid", (~F.exists("pairs", lambda p: p[0] == p[1]) & (F.size(F.array_distinct(ends)) == F.size("pairs"))).alias("legal"))


@query(f"WITH {C.RING_SQL} SELECT gid, n, u, v FROM e")
def graph6_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every graph written as a graph6 line and read back."""
    return R.from_graph6(R.to_graph6(C.ring(spark, sf_dir)))


@query()
def src_graph_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed JSON-lines corpus, written, read and held against its hashes."""
    path = R.scratch(spark, "graphs")
    R.write_graphs(G.hashed(C.ring(spark, sf_dir)), path)
    return R.read_graphs(spark, path).select("graph_hash", "order", F.size("edges").alias("m"))


@query()
def src_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit log in JSON lines, written and read; blank lines are skipped."""
    path = R.scratch(spark, "hits")
    hits(spark, sf_dir).select(F.concat("json", F.lit("\n")).alias("value")).write.option("compression", "gzip").text(path)
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get_json_object("value", "$.components.4").alias("flat"), F.get_json_object("value", "$.score.components.4.observed").alias("deep"))
