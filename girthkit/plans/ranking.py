"""Queries that rank and select: elites, beams, quotas, diversity, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girthkit.operators import graphs as G
from girthkit.plans.primitives import ranked
from girthkit.plans.registry import query
from girthkit.plans.scoring import SCORED, scored
from girthkit.sources import corpus as C

HASHED = SCORED + f", {C.HASH_SQL}, h AS (SELECT sc.*, graph_hash FROM sc JOIN hashes ON hashes.gid = sc.gid)"
NAMED = f"WITH {C.RING_SQL}, {C.HASH_SQL}, h AS (SELECT gn.*, graph_hash FROM gn JOIN hashes ON hashes.gid = gn.gid)"


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).join(G.hashed(C.ring(spark, sf_dir)).select("gid", "graph_hash"), "gid")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hashed(C.ring(spark, sf_dir)).select("gid", "n", "graph_hash")


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k of an order (a top-k report) and their places. Each task
    keeps k rows; only those meet."""
    return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query(HASHED + " SELECT gid, total, weighted, m, row_number() OVER (ORDER BY total, weighted, m, graph_hash) place FROM h ORDER BY place LIMIT 128")
def elite_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 128 best by (total, weighted, edges, hash), one a hash."""
    rows = G.keep_first(hashed(spark, sf_dir), "graph_hash", "gid")
    return top(rows, 128, "total", "weighted", "m", "graph_hash").select("gid", "total", "weighted", "m", "place")


@query(SCORED + " SELECT gid, n, r place FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY total, weighted, c4, gid) r FROM sc) WHERE r <= 8")
def beam_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam of eight in each order by (total, weighted, components, id)."""
    r = F.row_number().over(Window.partitionBy("n").orderBy("total", "weighted", "c4", "gid"))
    return scored(spark, sf_dir).withColumn("place", r).filter("place <= 8").select("gid", "n", "place")


@query(SCORED + ", d AS (SELECT c.gid, c.n, c.total FROM sc c JOIN sc p ON p.gid = c.gid - 13 WHERE c.c4 = p.c4) SELECT gid, n, r place FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY total, gid) r FROM d) WHERE r <= 8")
def beam_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam of children whose C4 is exactly their parent's."""
    rows = scored(spark, sf_dir)
    parent = rows.select((F.col("gid") + 13).alias("gid"), F.col("c4").alias("before"))
    r = F.row_number().over(Window.partitionBy("n").orderBy("total", "gid"))
    return rows.join(parent, "gid").filter("c4 = before").withColumn("place", r).filter("place <= 8").select("gid", "n", "place")


@query()
def beam_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve graphs of each order, taken in turn from three rankings and
    skipping those taken. Only the twelve heads of a ranking can be chosen, so
    a group holds at most 36 rows."""
    import pandas as pd

    rows = scored(spark, sf_dir)
    orders = {"a": ["total", "gid"], "b": ["weighted", "gid"], "c": ["c4", "m", "gid"]}
    for name, order in orders.items():
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy("n").orderBy(*order)))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        chosen: dict[int, str] = {}
        heads = {k: iter(group.sort_values(k)["gid"].tolist()) for k in "abc"}
        while len(chosen) < min(12, len(group)):
            for k, head in heads.items():
                for gid in head:
                    if gid not in chosen:
                        chosen[gid] = k
                        break
        picked = list(chosen.items())[:12]
        return pd.DataFrame({"n": [group["n"].iloc[0]] * len(picked), "gid": [g for g, _ in picked], "lane": [k for _, k in picked], "place": range(1, len(picked) + 1)})

    heads = rows.filter("a <= 36 OR b <= 36 OR c <= 36")
    return heads.groupBy("n").applyInPandas(choose, "n int, gid long, lane string, place int")


@query(SCORED + " SELECT gid, n, m, row_number() OVER (PARTITION BY n ORDER BY total, c4, c8, m, weighted, gid) place FROM sc")
def structural_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("n").orderBy("total", "c4", "c8", "m", "weighted", "gid")
    return scored(spark, sf_dir).select("gid", "n", "m", F.row_number().over(w).alias("place"))


@query(SCORED + " SELECT gid, total, row_number() OVER (PARTITION BY n ORDER BY total, CASE WHEN c8 = 0 THEN 1 ELSE 0 END, c8, gid) place FROM sc")
def compact_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by total, then a second energy, graphs without one last."""
    w = Window.partitionBy("n").orderBy("total", F.when(F.col("c8") == 0, 1).otherwise(0), "c8", "gid")
    return scored(spark, sf_dir).select("gid", "total", F.row_number().over(w).alias("place"))


@query(SCORED + ", s AS (SELECT *, row_number() OVER (PARTITION BY n, m ORDER BY total, gid) rn FROM sc) SELECT gid, n, m, rn, row_number() OVER (ORDER BY rn, n, m) place FROM s ORDER BY place LIMIT 200")
def stratified_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 graphs, one of each stratum (order, edges) in turn."""
    rn = F.row_number().over(Window.partitionBy("n", "m").orderBy("total", "gid"))
    return top(scored(spark, sf_dir).withColumn("rn", rn), 200, "rn", "n", "m").select("gid", "n", "m", "rn", "place")


@query(SCORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY total, gid) best, row_number() OVER (PARTITION BY n ORDER BY weighted DESC, gid) esc, count(*) OVER (PARTITION BY n) k FROM sc)
SELECT gid, n, CASE WHEN best <= 10 THEN 'best' WHEN esc <= 6 THEN 'escape' ELSE 'give_back' END lane FROM r WHERE best <= 10 OR esc <= 6 OR (best <= 12 AND k < 20)""")
def quota_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best and six escapes of each order; small orders give back two."""
    by = Window.partitionBy("n")
    rows = scored(spark, sf_dir).withColumns({"best": F.row_number().over(by.orderBy("total", "gid")), "esc": F.row_number().over(by.orderBy(F.desc("weighted"), "gid")), "k": F.count("*").over(by)})
    lane = F.when(F.col("best") <= 10, "best").when(F.col("esc") <= 6, "escape").otherwise("give_back")
    return rows.filter("best <= 10 OR esc <= 6 OR (best <= 12 AND k < 20)").select("gid", "n", lane.alias("lane"))


@query(SCORED + ", s AS (SELECT *, row_number() OVER (PARTITION BY n, c4 ORDER BY total, gid) k FROM sc), t AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY least(k, 2), total, gid) r FROM s) SELECT gid, n, r place FROM t WHERE r <= 25")
def diverse_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 of each order: first one of each signature (C4), then the rest."""
    k = F.row_number().over(Window.partitionBy("n", "c4").orderBy("total", "gid"))
    r = F.row_number().over(Window.partitionBy("n").orderBy(F.least("k", F.lit(2)), "total", "gid"))
    return scored(spark, sf_dir).withColumn("k", k).withColumn("place", r).filter("place <= 25").select("gid", "n", "place")


@query(SCORED + """, r AS (SELECT gid, n, row_number() OVER (PARTITION BY n ORDER BY total, gid) a, row_number() OVER (PARTITION BY n ORDER BY c4, m, gid) b, row_number() OVER (PARTITION BY n ORDER BY weighted DESC, gid) c FROM sc)
SELECT gid, n, CASE WHEN a <= 8 THEN 'main' WHEN b <= 6 THEN 'structural' WHEN c <= 4 THEN 'escape' END lane FROM r WHERE a <= 8 OR b <= 6 OR c <= 4""")
def beam_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lanes of a beam; a graph is in the first that takes it."""
    by = Window.partitionBy("n")
    rows = scored(spark, sf_dir).withColumns({"a": F.row_number().over(by.orderBy("total", "gid")), "b": F.row_number().over(by.orderBy("c4", "m", "gid")), "c": F.row_number().over(by.orderBy(F.desc("weighted"), "gid"))})
    lane = F.when(F.col("a") <= 8, "main").when(F.col("b") <= 6, "structural").when(F.col("c") <= 4, "escape")
    return rows.withColumn("lane", lane).filter("lane IS NOT NULL").select("gid", "n", "lane")


@query(f"WITH {C.RING_SQL}, k AS (SELECT gid, gid % 4 family, n parent, (row_number() OVER (PARTITION BY gid % 4, n ORDER BY gid) - 1) // 10 chunk FROM gn) SELECT gid, family, parent, chunk, row_number() OVER (ORDER BY chunk, family, parent, gid) place FROM k")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ten a family and parent, dealt in turn."""
    chunk = F.floor((F.row_number().over(Window.partitionBy("family", "parent").orderBy("gid")) - 1) / 10)
    rows = C.ring(spark, sf_dir).select("gid", "n").distinct().select("gid", (F.col("gid") % 4).alias("family"), F.col("n").alias("parent")).withColumn("chunk", chunk)
    return ranked(rows, ["chunk", "family", "parent", "gid"], "place")


@query(NAMED + " SELECT gid, n, r place FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY sha256('7:' || graph_hash), gid) r FROM h) WHERE r <= 32")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of 32 of each order by a seeded hash."""
    r = F.row_number().over(Window.partitionBy("n").orderBy(F.sha2(F.concat(F.lit("7:"), "graph_hash").cast("binary"), 256), "gid"))
    return named(spark, sf_dir).withColumn("place", r).filter("place <= 32").select("gid", "n", "place")


@query(NAMED + " SELECT gid, graph_hash, row_number() OVER (ORDER BY sha256('11:' || graph_hash), gid) - 1 position FROM h ORDER BY position LIMIT 100")
def line_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of 100 graphs drawn without replacement by a seed."""
    rows = named(spark, sf_dir).withColumn("o", F.sha2(F.concat(F.lit("11:"), "graph_hash").cast("binary"), 256))
    return top(rows, 100, "o", "gid").select("gid", "graph_hash", (F.col("place") - 1).alias("position"))


@query("SELECT event_id, CASE WHEN (event_id // 500) % 2 = 0 THEN 'RANDOM' ELSE 'ELITE' END phase FROM events")
def phase_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase of a budget of 500 evaluations that an event falls into."""
    ev = C.read(spark, sf_dir, "events")
    return ev.select("event_id", F.when(F.expr("(event_id div 500) % 2 = 0"), "RANDOM").otherwise("ELITE").alias("phase"))


@query(f"WITH RECURSIVE {C.RING_SQL}, up AS (SELECT gid leaf, gid, 0 depth FROM gn UNION ALL SELECT leaf, gid // 2, depth + 1 FROM up WHERE gid > 0) SELECT leaf, string_agg(CAST(gid AS VARCHAR), '/' ORDER BY depth DESC) path, max(depth) depth FROM up GROUP BY leaf")
def lineage_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root to every graph, whose parent is its id halved: a
    generation is a hop, all hops of an id are a function of the id."""
    rows = C.ring(spark, sf_dir).select(F.col("gid").alias("leaf")).distinct()
    hops = F.expr("filter(transform(sequence(0, 62), k -> shiftright(leaf, k)), (x, k) -> k = 0 OR shiftright(leaf, k - 1) > 0)")
    rows = rows.withColumn("hops", hops)
    return rows.select("leaf", F.array_join(F.transform(F.reverse("hops"), lambda x: x.cast("string")), "/").alias("path"), (F.size("hops") - 1).alias("depth"))


@query("SELECT user_id, first(event_id ORDER BY ts, event_id) first_id, count(*) hits FROM events WHERE value > 8 GROUP BY user_id")
def first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of a user that reaches the target, by (time, number)."""
    ev = C.read(spark, sf_dir, "events").filter("value > 8")
    return ev.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).getField("event_id").alias("first_id"), F.count("*").alias("hits"))
