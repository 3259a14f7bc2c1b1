"""Queries on cycles, their witnesses, geometry and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girthkit.functions import scalar
from girthkit.operators import cycles as K
from girthkit.operators import graphs as G
from girthkit.operators import halves as H
from girthkit.plans.primitives import APSP, C4_LIST, NUMBERED
from girthkit.plans.registry import query
from girthkit.sources import corpus as C

RING, ADJ = C.RING_SQL, C.ADJ_SQL


def walks_sql(length: int) -> str:
    """Paths from their least vertex and the cycles that close, for an oracle."""
    return f"""p AS (SELECT gid, u s, [u, v] path FROM adj WHERE u < v
  UNION ALL SELECT p.gid, p.s, list_append(p.path, a.v) FROM p JOIN adj a ON a.gid = p.gid AND a.u = p.path[-1] WHERE len(p.path) < {length} AND a.v > p.s AND NOT list_contains(p.path, a.v)),
closed AS (SELECT p.gid, len(p.path) length, p.path FROM p JOIN adj a ON a.gid = p.gid AND a.u = p.path[-1] AND a.v = p.s WHERE len(p.path) >= 3 AND p.path[2] < p.path[-1])"""


@query(f"WITH RECURSIVE {RING}, {ADJ}, {walks_sql(8)}, k AS (SELECT gid, count(*) c8 FROM closed WHERE length = 8 GROUP BY gid) SELECT gn.gid, coalesce(c8, 0) c8 FROM gn LEFT JOIN k ON k.gid = gn.gid")
def cycle8_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of length eight by joining half paths, graph by graph."""
    return H.count_lengths(C.ring_bits(spark, sf_dir), (8,)).select("gid", F.col("observed").alias("c8"))


@query(f"WITH RECURSIVE {RING}, {ADJ}, {walks_sql(8)}, k AS (SELECT gid, length, count(*) c FROM closed GROUP BY ALL) SELECT gn.gid, l.length, coalesce(c, 0) observed FROM gn CROSS JOIN (SELECT unnest([4, 8]) length) l LEFT JOIN k ON k.gid = gn.gid AND k.length = l.length")
def cycle_count_L(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of C4 and C8 by pairs of half paths."""
    found = K.count_evens(C.ring(spark, sf_dir), (4, 8))
    return found.select("gid", F.explode(F.array(*[F.struct(F.lit(x).alias("length"), F.col(f"c{x}").alias("observed")) for x in (4, 8)])).alias("k")).select("gid", "k.*")


@query(f"WITH {RING}, {ADJ}, {C.C4_SQL} SELECT g.gid, least(coalesce(c4, 0), 10) observed, coalesce(c4, 0) < 10 complete FROM gn g LEFT JOIN c4t ON c4t.gid = g.gid")
def cycle_count_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 that stops at ten."""
    return K.count_cycles(C.ring(spark, sf_dir), (4,), cap=10).select("gid", "observed", "complete")


@query(f"WITH RECURSIVE {RING.replace('WHERE a <> b)', 'WHERE a <> b AND a < n // 2 AND b < n // 2)')}, {ADJ}, {walks_sql(6)} SELECT gid, length, count(*) observed FROM closed WHERE length IN (4, 6) GROUP BY ALL")
def cycle_count_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 and C6 within the lower half of the vertices."""
    part = C.ring(spark, sf_dir).filter("u < n div 2 AND v < n div 2")
    return K.count_cycles(part, (4, 6)).filter("observed > 0").select("gid", "length", "observed")


@query(f"WITH RECURSIVE {RING}, {ADJ}, {walks_sql(8)} SELECT gid, length, count(*) observed FROM closed WHERE length BETWEEN 4 AND 8 GROUP BY ALL")
def cycle_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.count_lengths(C.ring_bits(spark, sf_dir), (4, 5, 6, 7, 8)).filter("observed > 0")


@query(f"WITH RECURSIVE {RING}, {ADJ}, {walks_sql(5)} SELECT gid, array_to_string(path, '-') vertices FROM closed WHERE length = 5")
def cycle_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every five-cycle by the bit-mask search."""
    return K.witnesses(C.ring(spark, sf_dir), 5).select("gid", F.array_join(F.transform("vertices", lambda v: v.cast("string")), "-").alias("vertices"))


CASCADE = f"""WITH RECURSIVE {RING}, {ADJ}, {walks_sql(8)},
s AS (SELECT gn.gid, count(*) FILTER (WHERE length = 4) a, count(*) FILTER (WHERE length = 8) b FROM gn LEFT JOIN closed ON closed.gid = gn.gid GROUP BY gn.gid)"""


@query(CASCADE + " SELECT gid, CASE WHEN a + b <= 250 THEN a + b END total, CASE WHEN a > 250 THEN 4 WHEN a + b > 250 THEN 8 END pruned_at FROM s")
def cascade_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + C8, pruned when the proven part passes 250; ties go on."""
    return K.cascade(C.ring(spark, sf_dir), (4, 8), 250)


@query(CASCADE + " SELECT gid, CASE WHEN a + b < 250 THEN a + b END total, CASE WHEN a >= 250 THEN 4 WHEN a + b >= 250 THEN 8 END pruned_at FROM s")
def incumbent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + C8, pruned when the proven part reaches 250."""
    return K.cascade(C.ring(spark, sf_dir), (4, 8), 250, strict=True)


@query(CASCADE + """, pr AS (SELECT CASE WHEN a > 250 THEN 4 WHEN a + b > 250 THEN 8 ELSE 0 END pruned_at FROM s)
SELECT pruned_at, count(*) graphs, (SELECT count(*) FROM pr) - count(*) others FROM pr GROUP BY pruned_at""")
def cascade_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs by the length at which they were pruned (0: scored)."""
    scored = K.cascade(C.ring(spark, sf_dir), (4, 8), 250).groupBy(F.coalesce("pruned_at", F.lit(0)).alias("pruned_at")).agg(F.count("*").alias("graphs"))
    total = scored.agg(F.sum("graphs").alias("t"))  # one row
    return scored.crossJoin(F.broadcast(total)).select("pruned_at", "graphs", (F.col("t") - F.col("graphs")).alias("others"))


BOUNDED = f"WITH {RING}, {ADJ}, {C.C4_SQL}, s AS (SELECT g.gid, coalesce(c4, 0) c4 FROM gn g LEFT JOIN c4t ON c4t.gid = g.gid)"


@query(BOUNDED + " SELECT gid, least(c4, 16) lower, least(c4, 16) upper, CASE WHEN c4 >= 16 THEN 'SATURATED_AT_CAP' ELSE 'EXACT' END status FROM s")
def score_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and bounds of C4 with a cap of 16."""
    found = K.count_cycles(C.ring(spark, sf_dir), (4,), cap=16)
    state = scalar.status(F.col("observed"), F.col("complete"), 16)
    lower, upper = scalar.count_bounds(F.col("observed"), state, 16)
    return found.select("gid", lower.alias("lower"), upper.alias("upper"), state.alias("status"))


LOADS = f"""{C4_LIST}, sides AS (SELECT gid, a, b, c, d, unnest([[least(a,b), greatest(a,b)], [least(b,c), greatest(b,c)], [least(c,d), greatest(c,d)], [least(a,d), greatest(a,d)]]) s FROM cyc)"""


@query(f"WITH {RING}, {ADJ}, {LOADS} SELECT gid, s[1] u, s[2] v, count(*) load, dense_rank() OVER (PARTITION BY gid ORDER BY count(*) DESC) heat FROM sides GROUP BY gid, s")
def cycle_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-cycles through each edge, and the rank of that load in the graph."""
    sides = G.c4_cycles(C.ring(spark, sf_dir)).select("gid", F.explode(F.array(*[scalar.edge(x, y) for x, y in (("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"))])).alias("s"))
    load = sides.groupBy("gid", F.col("s.u").alias("u"), F.col("s.v").alias("v")).agg(F.count("*").alias("load"))
    return load.withColumn("heat", F.dense_rank().over(Window.partitionBy("gid").orderBy(F.desc("load"))))


@query()
def hitting_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest edges and vertices that meet all four-cycles of a graph."""
    return K.hitting_numbers(K.witnesses(G.admissible_edges(C.ring(spark, sf_dir)), 4))


GEOMETRY = f"""WITH RECURSIVE {RING}, {ADJ}, {APSP}, {NUMBERED},
vx AS (SELECT gid, i, unnest(vs) x FROM num),
pd AS (SELECT p.gid, p.i, p.j, any_value(shared_edges) se, min(CASE WHEN a.x = b.x THEN 0 ELSE d.d END) distance FROM prs p JOIN vx a ON a.gid = p.gid AND a.i = p.i JOIN vx b ON b.gid = p.gid AND b.i = p.j
  LEFT JOIN dist d ON d.gid = p.gid AND d.u = a.x AND d.v = b.x GROUP BY ALL),
geo AS (SELECT gid, count(*) pairs, min(distance) d_min, avg(distance) d_mean, max(distance) d_max, count(*) FILTER (WHERE se = 0) edge_disjoint, string_agg(DISTINCT CAST(distance AS VARCHAR), ',' ORDER BY CAST(distance AS VARCHAR)) signature FROM pd GROUP BY gid)"""


def geometry(e: DataFrame) -> DataFrame:
    """One row a graph from the pairs of its four-cycles."""
    return K.cycle_pairs(e).groupBy("gid").agg(
        F.count("*").alias("pairs"), F.min("distance").alias("d_min"), F.avg("distance").alias("d_mean"), F.max("distance").alias("d_max"),
        F.count_if(F.col("shared_edges") == 0).alias("edge_disjoint"),
        F.array_join(F.array_sort(F.collect_set(F.col("distance").cast("string"))), ",").alias("signature"),
    )


@query(GEOMETRY + " SELECT gid, pairs, d_min, round(d_mean, 9) d_mean, d_max, edge_disjoint, signature FROM geo")
def c4_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry(C.ring(spark, sf_dir)).withColumn("d_mean", F.round("d_mean", 9))


@query(GEOMETRY + " SELECT n, count(*) graphs, round(avg(d_mean), 9) mean_d, round(median(d_mean), 9) median_d, CAST(sum(pairs) AS BIGINT) pairs, count(*) FILTER (WHERE d_max = 0) all_meet FROM geo JOIN gn ON gn.gid = geo.gid GROUP BY n")
def geometry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry by order."""
    e = C.ring(spark, sf_dir)
    rows = geometry(e).join(e.select("gid", "n").distinct(), "gid")
    return rows.groupBy("n").agg(F.count("*").alias("graphs"), F.round(F.avg("d_mean"), 9).alias("mean_d"), F.round(F.median("d_mean"), 9).alias("median_d"), F.sum("pairs").alias("pairs"), F.count_if(F.col("d_max") == 0).alias("all_meet"))


@query(GEOMETRY + " SELECT n, round(avg(d_mean) FILTER (WHERE geo.gid % 2 = 0) - avg(d_mean) FILTER (WHERE geo.gid % 2 = 1), 9) contrast FROM geo JOIN gn ON gn.gid = geo.gid GROUP BY n")
def group_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of even minus odd graphs by order; null if either is empty."""
    e = C.ring(spark, sf_dir)
    rows = geometry(e).join(e.select("gid", "n").distinct(), "gid")
    mean = lambda r: F.avg(F.when(F.col("gid") % 2 == r, F.col("d_mean")))
    return rows.groupBy("n").agg(F.round(mean(0) - mean(1), 9).alias("contrast"))


@query(GEOMETRY + """, sz AS (SELECT gid, count(*) m FROM e GROUP BY gid),
t AS (SELECT m, n, count(*) FILTER (WHERE geo.gid % 2 = 0) targets, count(*) FILTER (WHERE geo.gid % 2 = 1) controls, avg(d_mean) FILTER (WHERE geo.gid % 2 = 0) a, avg(d_mean) FILTER (WHERE geo.gid % 2 = 1) b FROM geo JOIN gn ON gn.gid = geo.gid JOIN sz ON sz.gid = geo.gid GROUP BY m, n)
SELECT n, m, targets, controls, round(a, 9) target_mean, round(b, 9) control_mean FROM t WHERE targets > 0 AND controls > 0""")
def matched_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata (order, edges) that both groups have."""
    e = C.ring(spark, sf_dir)
    rows = geometry(e).join(e.groupBy("gid", "n").agg(F.count("*").alias("m")), "gid")
    even = F.col("gid") % 2 == 0
    out = rows.groupBy("n", "m").agg(F.count_if(even).alias("targets"), F.count_if(~even).alias("controls"), F.round(F.avg(F.when(even, F.col("d_mean"))), 9).alias("target_mean"), F.round(F.avg(F.when(~even, F.col("d_mean"))), 9).alias("control_mean"))
    return out.filter("targets > 0 AND controls > 0")


@query(GEOMETRY + " SELECT signature, count(*) graphs, row_number() OVER (ORDER BY count(*) DESC, signature) place FROM geo GROUP BY signature ORDER BY 3 LIMIT 5")
def top_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent distance signatures (a top-k report)."""
    top = geometry(C.ring(spark, sf_dir)).groupBy("signature").agg(F.count("*").alias("graphs")).orderBy(F.desc("graphs"), "signature").limit(5)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("graphs"), "signature")))


@query(GEOMETRY + " SELECT gid, round(avg(distance), 9) cycle_min, CAST(sum(distance) AS BIGINT) spread FROM pd GROUP BY gid")
def compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean least distance over pairs of four-cycles."""
    return K.cycle_pairs(C.ring(spark, sf_dir)).groupBy("gid").agg(F.round(F.avg("distance"), 9).alias("cycle_min"), F.sum("distance").cast("long").alias("spread"))


@query(f"WITH RECURSIVE {RING}, {ADJ}, {APSP} SELECT gid, min(CASE WHEN u = v THEN 0 ELSE d END) d FROM dist WHERE u % 5 = 0 AND v % 5 = 2 GROUP BY gid")
def set_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance between the vertices 0, 5, 10.. and 2, 7, 12.. of each graph."""
    return G.distances(C.ring(spark, sf_dir)).filter("u % 5 = 0 AND v % 5 = 2").groupBy("gid").agg(F.min("d").alias("d"))


SPLIT = """link AS (SELECT gid, u, v FROM e WHERE {keep} UNION ALL SELECT gid, v, u FROM e WHERE {keep}),
r AS (SELECT gid, CAST(a AS INT) s, CAST(a AS INT) u FROM pts {sub} UNION SELECT r.gid, r.s, l.v FROM r JOIN link l ON l.gid = r.gid AND l.u = r.u),
lab AS (SELECT gid, u, min(s) c FROM r GROUP BY ALL)"""


@query(f"WITH RECURSIVE {RING}, {SPLIT.format(keep='u % 3 <> 0 AND v % 3 <> 0', sub='WHERE a % 3 <> 0')} SELECT gid, c component, count(*) size FROM lab GROUP BY ALL")
def components_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the vertices that are no multiples of three."""
    e = C.ring(spark, sf_dir)
    inside = C.vertices(e).filter("u % 3 <> 0")
    reach = G.distances(e.filter("u % 3 <> 0 AND v % 3 <> 0")).select("gid", "u", "v")
    label = inside.join(reach, ["gid", "u"], "left").groupBy("gid", "u").agg(F.least(F.col("u"), F.min("v")).alias("component"))
    return label.groupBy("gid", "component").agg(F.count("*").alias("size"))


@query(f"WITH RECURSIVE {RING}, {SPLIT.format(keep='NOT (u = 0 AND v = 1)', sub='')}, k AS (SELECT gid, c, count(*) size FROM lab GROUP BY ALL) SELECT gid, string_agg(CAST(size AS VARCHAR), ',' ORDER BY size) sizes FROM k GROUP BY gid")
def bridge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component sizes after the edge 0-1 is taken away."""
    e = C.ring(spark, sf_dir)
    reach = G.distances(e.filter("NOT (u = 0 AND v = 1)")).select("gid", "u", "v")
    label = C.vertices(e).join(reach, ["gid", "u"], "left").groupBy("gid", "u").agg(F.least(F.col("u"), F.min("v")).alias("c"))
    sizes = label.groupBy("gid", "c").agg(F.count("*").alias("size")).groupBy("gid").agg(F.sort_array(F.collect_list("size")).alias("s"))
    return sizes.select("gid", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sizes"))
