"""Queries on scores: weights, energy, best so far, deltas, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girthkit.functions import scalar
from girthkit.operators import cycles as K
from girthkit.operators import graphs as G
from girthkit.plans.cycles import walks_sql
from girthkit.plans.primitives import OK
from girthkit.plans.registry import query
from girthkit.sources import corpus as C

RING, ADJ, C4 = C.RING_SQL, C.ADJ_SQL, C.C4_SQL

#: Cap of a bounded count.
CAP = 64
#: Scores of every ring graph: counts of the lengths 4 and 8, their total and
#: weighted total.
SCORED = f"""WITH RECURSIVE {RING}, {ADJ}, {C4}, {walks_sql(8)},
c8t AS (SELECT gid, count(*) c8 FROM closed WHERE length = 8 GROUP BY gid),
sz AS (SELECT gid, any_value(n) n, count(*) m FROM e GROUP BY gid),
sc AS MATERIALIZED (SELECT sz.gid, sz.n, m, coalesce(c4, 0) c4, coalesce(c8, 0) c8, coalesce(c4, 0) + coalesce(c8, 0) total, 16 * coalesce(c4, 0) + 8 * coalesce(c8, 0) weighted
  FROM sz LEFT JOIN c4t ON c4t.gid = sz.gid LEFT JOIN c8t ON c8t.gid = sz.gid)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, n, m, c4, c8, total, weighted) of every ring graph."""
    weight = lambda x: scalar.cycle_weight(F.lit(x))
    rows = K.count_evens(C.ring(spark, sf_dir), (4, 8))
    return rows.withColumns({"total": F.col("c4") + F.col("c8"), "weighted": weight(4) * F.col("c4") + weight(8) * F.col("c8")})


@query(SCORED + " SELECT gid, total, weighted FROM sc")
def total_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("gid", "total", "weighted")


ENERGY = SCORED + """, lim AS (SELECT *, least(c4, 64) + least(c8, 64) t, 16 * least(c4, 64) + 8 * least(c8, 64) w, (3 * n + 1) // 2 lo FROM sc),
en AS (SELECT *, CAST((t * 1537 + w) * (n * (n - 1) // 2 - lo + 1) + m - lo AS BIGINT) energy, CAST((CAST(128 AS BIGINT) * 1537 + 1536) * (n * (n - 1) // 2 - lo + 1) + n * (n - 1) // 2 - lo AS BIGINT) energy_max FROM lim)"""


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    four, eight = (F.least(c, F.lit(CAP).cast("long")) for c in ("c4", "c8"))
    rows = scored(spark, sf_dir).withColumns({"t": four + eight, "w": scalar.cycle_weight(F.lit(4)) * four + scalar.cycle_weight(F.lit(8)) * eight})
    energy, most = scalar.energy_columns(F.col("n"), F.col("t"), F.col("w"), F.col("m"), 2, 24, CAP)
    return rows.withColumns({"energy": energy, "energy_max": most})


@query(ENERGY + " SELECT gid, energy, energy_max, round(1 - energy / energy_max, 9) utility FROM en")
def energy_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of (total, weighted, edges) of the capped counts, and the utility."""
    return energies(spark, sf_dir).select("gid", "energy", "energy_max", F.round(1 - F.col("energy") / F.col("energy_max"), 9).alias("utility"))


@query(ENERGY + ", best AS (SELECT n, energy_max, min(energy) OVER (PARTITION BY n ORDER BY gid) best FROM en) SELECT n, CAST(sum(energy_max - best) AS BIGINT) numerator, CAST(any_value(energy_max) * count(*) AS BIGINT) denominator FROM best GROUP BY n")
def order_balanced_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean best-so-far utility of each order as an exact fraction; the mean
    over orders combines these few rows as fractions."""
    best = F.min("energy").over(Window.partitionBy("n").orderBy("gid").rowsBetween(Window.unboundedPreceding, 0))
    rows = energies(spark, sf_dir).withColumn("best", best)
    return rows.groupBy("n").agg(F.sum(F.col("energy_max") - F.col("best")).alias("numerator"), (F.max("energy_max") * F.count("*")).alias("denominator"))


@query(SCORED + " SELECT gid, max(total) OVER w best_total, max(weighted) OVER w best_weighted FROM sc WINDOW w AS (PARTITION BY n ORDER BY gid ROWS UNBOUNDED PRECEDING)")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running maxima of both endpoints in each order's episode."""
    w = Window.partitionBy("n").orderBy("gid").rowsBetween(Window.unboundedPreceding, 0)
    return scored(spark, sf_dir).select("gid", F.max("total").over(w).alias("best_total"), F.max("weighted").over(w).alias("best_weighted"))


DELTAS = SCORED + """, lens AS (SELECT gid, 4 length, c4 observed FROM sc UNION ALL SELECT gid, 8, c8 FROM sc WHERE c8 > 0),
st AS (SELECT gid, length, least(observed, 64) lo, observed < 64 exact FROM lens),
pr AS (SELECT a.gid child, a.gid - 13 parent, a.length, a.lo, a.exact FROM st a WHERE a.gid >= 13 UNION ALL SELECT p.gid + 13, p.gid, p.length, 0, true FROM st p
  WHERE p.gid + 13 IN (SELECT gid FROM sc) AND NOT EXISTS (SELECT 1 FROM st a WHERE a.gid = p.gid + 13 AND a.length = p.length)),
dl AS (SELECT pr.child, pr.length, pr.lo clo, pr.exact cex, coalesce(p.lo, 0) plo, coalesce(p.exact, true) pex FROM pr LEFT JOIN st p ON p.gid = pr.parent AND p.length = pr.length)"""


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, length, clo, cex, plo, pex): a graph and the one 13 ids before,
    of the same order, length by length; a missing component counts 0 exactly.
    Counts of CAP and more are known to be at least that only."""
    rows = scored(spark, sf_dir)
    long = rows.select("gid", F.explode(F.array(F.struct(F.lit(4).alias("length"), F.col("c4").alias("o")), F.struct(F.lit(8).alias("length"), F.col("c8").alias("o")))).alias("x")).select("gid", "x.length", "x.o").filter("length = 4 OR o > 0")
    state = long.select("gid", "length", F.least("o", F.lit(CAP).cast("long")).alias("lo"), (F.col("o") < CAP).alias("ex"))
    child = state.filter("gid >= 13").select(F.col("gid").alias("child"), "length", F.col("lo").alias("clo"), F.col("ex").alias("cex"))
    parent = state.join(rows.select((F.col("gid") - 13).alias("gid")), "gid", "left_semi").select((F.col("gid") + 13).alias("child"), "length", F.col("lo").alias("plo"), F.col("ex").alias("pex"))
    both = child.join(parent, ["child", "length"], "full")
    return both.select("child", "length", F.coalesce("clo", F.lit(0)).alias("clo"), F.coalesce("cex", F.lit(True)).alias("cex"), F.coalesce("plo", F.lit(0)).alias("plo"), F.coalesce("pex", F.lit(True)).alias("pex"))


@query(DELTAS + " SELECT child, length, CASE WHEN pex THEN clo - plo END lower, CASE WHEN cex THEN clo - plo END upper FROM dl")
def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the change per length; open where a count is not exact."""
    diff = F.col("clo") - F.col("plo")
    return deltas(spark, sf_dir).select("child", "length", F.when(F.col("pex"), diff).alias("lower"), F.when(F.col("cex"), diff).alias("upper"))


@query(DELTAS + ", b AS (SELECT child, length, CASE WHEN cex THEN clo - least(plo, clo) END up, greatest(0, CASE WHEN pex THEN clo - plo ELSE 0 END) lo FROM dl) SELECT child, CAST(sum(lo) AS BIGINT) lower, CASE WHEN count(up) = count(*) THEN CAST(sum(up) AS BIGINT) END upper FROM b GROUP BY child")
def delta_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total change of a growth step, which only adds cycles. A missing upper
    bound makes the total's missing; an exact child bounds its parent."""
    d = deltas(spark, sf_dir)
    lower = F.greatest(F.lit(0), F.when(F.col("pex"), F.col("clo") - F.col("plo")).otherwise(F.lit(0)))
    upper = F.when(F.col("cex"), F.col("clo") - F.least("plo", "clo"))
    d = d.select("child", lower.alias("lo"), upper.alias("up"))
    return d.groupBy("child").agg(F.sum("lo").alias("lower"), F.when(F.count("up") == F.count("*"), F.sum("up")).alias("upper"))


@query(DELTAS + " SELECT child, length, greatest(0, clo - plo) lower, greatest(0, clo - plo) upper FROM dl")
def delta_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change on the capped scale, where a capped count is exact."""
    diff = F.greatest(F.lit(0), F.col("clo") - F.col("plo"))
    return deltas(spark, sf_dir).select("child", "length", diff.alias("lower"), diff.alias("upper"))


FAMILIES = SCORED + """, ch AS (SELECT c.gid, c.total - p.total delta, 'family' || (c.gid % 4) family FROM sc c JOIN sc p ON p.gid = c.gid - 13)"""


@query(FAMILIES + " SELECT family, count(*) scored, count(*) FILTER (WHERE delta < 0) improving, count(*) FILTER (WHERE delta = 0) neutral, min(delta) best, arg_min(gid, delta * 1000000 + gid) best_gid FROM ch GROUP BY family")
def family_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored, improving and neutral children by family, and the best."""
    rows = scored(spark, sf_dir).select("gid", "total")
    parent = rows.select((F.col("gid") + 13).alias("gid"), F.col("total").alias("before"))
    ch = rows.join(parent, "gid").select("gid", (F.col("total") - F.col("before")).alias("delta"), F.concat(F.lit("family"), (F.col("gid") % 4).cast("string")).alias("family"))
    return ch.groupBy("family").agg(F.count("*").alias("scored"), F.count_if(F.col("delta") < 0).alias("improving"), F.count_if(F.col("delta") == 0).alias("neutral"), F.min("delta").alias("best"), F.min_by("gid", F.struct("delta", "gid")).alias("best_gid"))


@query("""SELECT event_type arm, user_id % 7 grp, count(*) runs, round(avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END), 9) success_rate, round(median(value) FILTER (WHERE value > 5), 9) median_value FROM events GROUP BY ALL""")
def bench_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rate and median over successes by group and arm."""
    ev = C.read(spark, sf_dir, "events")
    good = F.col("value") > 5
    return ev.groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 7).alias("grp")).agg(F.count("*").alias("runs"), F.round(F.avg(F.when(good, 1.0).otherwise(0.0)), 9).alias("success_rate"), F.round(F.median(F.when(good, F.col("value"))), 9).alias("median_value"))


@query(f"""WITH RECURSIVE {RING}, {ADJ}, {OK}, sz AS (SELECT gid, any_value(n) n, count(*) m FROM e GROUP BY gid), k AS (SELECT sz.*, sz.gid IN (SELECT gid FROM ok) good, row_number() OVER (PARTITION BY n, m ORDER BY sz.gid) r FROM sz),
g AS (SELECT unnest(range(0, 5)) s)
SELECT 'gen' || s generator, count(k.gid) attempts, count(k.gid) FILTER (WHERE NOT good) rejected, count(k.gid) FILTER (WHERE good AND r > 1) duplicates, count(k.gid) FILTER (WHERE good AND r = 1) accepted FROM g LEFT JOIN k ON k.gid % 4 = s GROUP BY s""")
def corpus_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, rejected, duplicates (here: same order and size) and accepted
    by generator; a generator without attempts gets zeros."""
    e = C.ring(spark, sf_dir)
    good = G.admissible_edges(e).select("gid", F.lit(True).alias("good")).distinct()
    rows = e.groupBy("gid", "n").agg(F.count("*").alias("m")).join(good, "gid", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("n", "m").orderBy("gid"))).withColumn("s", F.col("gid") % 4)
    names = spark.range(5).toDF("s")
    out = names.join(rows, "s", "left").groupBy("s").agg(F.count("gid").alias("attempts"), F.count_if(~F.col("good")).alias("rejected"), F.count_if(F.col("good") & (F.col("r") > 1)).alias("duplicates"), F.count_if(F.col("good") & (F.col("r") == 1)).alias("accepted"))
    return out.select(F.concat(F.lit("gen"), F.col("s").cast("string")).alias("generator"), "attempts", "rejected", "duplicates", "accepted")


@query(SCORED + ", sh AS (SELECT gid % 16 shard, count(*) generated, count(*) FILTER (WHERE total <= 250) scored FROM sc GROUP BY 1) SELECT CAST(sum(generated) AS BIGINT) generated, CAST(sum(scored) AS BIGINT) scored, CAST(sum(generated - scored) AS BIGINT) pruned, count(*) = 16 exact FROM sh")
def shard_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the shards' ledger; exact when all 16 shards are there."""
    sh = scored(spark, sf_dir).groupBy((F.col("gid") % 16).alias("shard")).agg(F.count("*").alias("generated"), F.count_if(F.col("total") <= 250).alias("scored"))
    return sh.agg(F.sum("generated").alias("generated"), F.sum("scored").alias("scored"), F.sum(F.col("generated") - F.col("scored")).alias("pruned"), (F.count("*") == 16).alias("exact"))


@query(f"WITH {RING}, {ADJ}, {C.DEG_SQL} SELECT gid % 4 generator, round(avg(d), 9) mean_d, min(d) min_d, max(d) max_d, round(var_pop(d), 9) var_d FROM deg GROUP BY 1")
def generator_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees pooled over all vertices of a generator's graphs."""
    return G.degrees(C.ring(spark, sf_dir)).groupBy((F.col("gid") % 4).alias("generator")).agg(F.round(F.avg("d"), 9).alias("mean_d"), F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.round(F.var_pop("d"), 9).alias("var_d"))
