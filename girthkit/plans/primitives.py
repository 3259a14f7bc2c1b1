"""Queries on degrees, connectedness, triangles, four-cycles and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girthkit.functions import scalar
from girthkit.operators import cycles as K
from girthkit.operators import graphs as G
from girthkit.plans.registry import query
from girthkit.sources import corpus as C
from girthkit.sources.records import scratch

RING, ADJ, DEG, C4, C3 = C.RING_SQL, C.ADJ_SQL, C.DEG_SQL, C.C4_SQL, C.C3_SQL
REACH = """reach AS (SELECT gid, n, CAST(0 AS INT) u FROM gn UNION SELECT r.gid, r.n, a.v FROM reach r JOIN adj a ON a.gid = r.gid AND a.u = r.u),
conn AS (SELECT gid, n, count(*) = n connected FROM reach GROUP BY gid, n)"""
OK = f"""{DEG},
{REACH},
mind AS (SELECT gid, n, min(d) min_degree FROM deg GROUP BY gid, n),
ok AS (SELECT m.gid FROM mind m JOIN conn c ON c.gid = m.gid WHERE m.min_degree >= 3 AND c.connected)"""
FLAGSHIP = f"""WITH RECURSIVE {RING}, {ADJ}, {OK}, {C4},
dt AS (SELECT gid, string_agg(d || '^' || k, ',' ORDER BY d) compact FROM (SELECT gid, d, count(*) k FROM deg GROUP BY gid, d) GROUP BY gid)
SELECT e.gid, any_value(e.n) n, count(*) m, any_value(compact) degrees, any_value(c4) c4,
  row_number() OVER (ORDER BY any_value(c4), count(*), e.gid) place
FROM e JOIN ok ON ok.gid = e.gid JOIN dt ON dt.gid = e.gid JOIN c4t ON c4t.gid = e.gid GROUP BY e.gid"""


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with its place in a total order. Rows are dealt to ranges of the
    order, numbered within their range, written once, and shifted by the sizes
    of the ranges before, so no task holds all rows."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    dealt = dealt.withColumn("_in", F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)).drop("_at")
    path = scratch(spark, "ranked")
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    return rows.join(starts, "_part").withColumn(name, F.col("_in") + F.col("_before") + 1).drop("_part", "_in", "_before")


@query(FLAGSHIP)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissible graphs by exact four-cycle count, edges and id."""
    e = G.admissible_edges(C.ring(spark, sf_dir)).persist()
    m = e.groupBy("gid", "n").agg(F.count("*").alias("m"))
    out = m.join(G.degree_text(e).select("gid", F.col("compact").alias("degrees")), "gid").join(G.c4_count(e), "gid")
    placed = ranked(out, ["c4", "m", "gid"], "place").select("gid", "n", "m", "degrees", "c4", "place")
    e.unpersist()
    return placed


@query(f"WITH {RING} SELECT gid, n, u, v FROM e")
def edge_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ring(spark, sf_dir)


@query(f"WITH {RING}, {ADJ}, {DEG} SELECT gid, n, u, d FROM deg")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(C.ring(spark, sf_dir))


@query(f"WITH {RING}, {ADJ}, {DEG} SELECT gid, n, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) sequence FROM deg GROUP BY gid, n")
def degree_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_text(C.ring(spark, sf_dir)).select("gid", "n", "sequence")


@query(f"WITH {RING}, {ADJ}, {DEG}, k AS (SELECT gid, n, d, count(*) k FROM deg GROUP BY gid, n, d) SELECT gid, n, string_agg(d || '^' || k, ',' ORDER BY d) compact FROM k GROUP BY gid, n")
def degree_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_text(C.ring(spark, sf_dir)).select("gid", "n", "compact")


@query(f"WITH RECURSIVE {C.DENSE_SQL}, {ADJ}, {REACH} SELECT gid, n, connected FROM conn")
def is_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.connected(C.dense(spark, sf_dir))


@query(f"""WITH RECURSIVE {RING}, {ADJ}, {OK}
SELECT m.gid, m.n, m.min_degree, m.n BETWEEN 4 AND 63 AND connected AND min_degree >= 3 admissible,
  CASE WHEN m.n NOT BETWEEN 4 AND 63 THEN 'order' WHEN NOT connected THEN 'disconnected' WHEN min_degree < 3 THEN 'degree' ELSE 'none' END reason
FROM mind m JOIN conn c ON c.gid = m.gid""")
def admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.admissible(C.ring(spark, sf_dir))


@query(f"WITH {RING} SELECT gid, n, count(*) m, count(*) - (3 * n + 1) // 2 excess FROM e GROUP BY gid, n")
def edge_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.ring(spark, sf_dir).groupBy("gid", "n").agg(F.count("*").alias("m"))
    return out.withColumn("excess", scalar.edge_excess(F.col("m"), F.col("n")))


@query(f"WITH {RING} SELECT gid, n, concat_ws(',', '4', CASE WHEN n >= 8 THEN '8' END, CASE WHEN n >= 16 THEN '16' END, CASE WHEN n >= 32 THEN '32' END) lengths FROM gn")
def forbidden_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    gn = C.ring(spark, sf_dir).select("gid", "n").distinct()
    return gn.select("gid", "n", F.array_join(F.transform(scalar.forbidden_lengths(F.col("n")), lambda x: x.cast("string")), ",").alias("lengths"))


@query(f"WITH {RING}, {ADJ} SELECT x.gid, x.u, y.u w, count(*) k FROM adj x JOIN adj y ON x.gid = y.gid AND x.v = y.v AND x.u < y.u GROUP BY ALL")
def common_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.common_neighbours(C.ring(spark, sf_dir))


@query(f"WITH {RING}, {ADJ}, {C4} SELECT g.gid, coalesce(c4, 0) c4 FROM gn g LEFT JOIN c4t ON c4t.gid = g.gid")
def c4_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.c4_count(C.ring(spark, sf_dir))


@query(f"WITH {C.DENSE_SQL}, {ADJ}, {C4} SELECT g.gid, least(coalesce(c4, 0), 101) c4 FROM gn g LEFT JOIN c4t ON c4t.gid = g.gid")
def c4_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-cycles up to a ceiling of 100; 101 stands for more."""
    return G.c4_count(C.dense(spark, sf_dir)).select("gid", F.least("c4", F.lit(101).cast("long")).alias("c4"))


@query(f"WITH {RING}, {ADJ}, {C4} SELECT g.gid, coalesce(c4, 0) > 0 conflict FROM gn g LEFT JOIN c4t ON c4t.gid = g.gid")
def c4_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two vertices have two common neighbours."""
    e = C.ring(spark, sf_dir)
    found = G.common_neighbours(e).groupBy("gid").agg(F.bool_or(F.col("k") >= 2).alias("conflict"))
    return e.select("gid").distinct().join(found, "gid", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


@query(f"""WITH {RING}, {ADJ} SELECT DISTINCT x.gid, x.u, z.v FROM adj x JOIN adj y ON y.gid = x.gid AND y.u = x.v JOIN adj z ON z.gid = x.gid AND z.u = y.v
WHERE x.u <> y.v AND x.v <> z.v AND x.u < z.v AND NOT EXISTS (SELECT 1 FROM e WHERE e.gid = x.gid AND e.u = x.u AND e.v = z.v)""")
def c4_forced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.c4_forced_edges(C.ring(spark, sf_dir))


@query(f"""WITH {RING}, t AS (SELECT x.gid, x.u a, x.v b, y.v c FROM e x JOIN e y ON x.gid = y.gid AND x.v = y.u JOIN e z ON z.gid = x.gid AND z.u = x.u AND z.v = y.v),
p AS (SELECT gid, unnest([a, b, c]) u FROM t), k AS (SELECT gid, u, count(*) t FROM p GROUP BY ALL)
SELECT g.gid, string_agg(CAST(coalesce(t, 0) AS VARCHAR), ',' ORDER BY coalesce(t, 0)) per_vertex, coalesce(CAST(sum(t) AS BIGINT), 0) // 3 triangles
FROM (SELECT gid, CAST(unnest(range(0, n)) AS INT) u FROM gn) g LEFT JOIN k ON k.gid = g.gid AND k.u = g.u GROUP BY g.gid""")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles through each vertex as a sorted invariant."""
    e = C.ring(spark, sf_dir)
    k = G.triangles(e).select("gid", F.explode(F.array("a", "b", "c")).alias("u")).groupBy("gid", "u").agg(F.count("*").alias("t"))
    per = C.vertices(e).join(k, ["gid", "u"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    return per.groupBy("gid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x.cast("string")), ",").alias("per_vertex"), F.expr("sum(t) div 3").alias("triangles"))


@query(f"""WITH {RING} SELECT x.gid, count(*) pairs, CAST(sum(x.u * 31 + x.v * 17 + y.u * 7 + y.v) AS BIGINT) mark FROM e x JOIN e y ON x.gid = y.gid AND (x.u, x.v) < (y.u, y.v)
WHERE x.u <> y.u AND x.u <> y.v AND x.v <> y.u AND x.v <> y.v GROUP BY x.gid""")
def disjoint_edge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = G.disjoint_edge_pairs(C.ring(spark, sf_dir))
    return pairs.groupBy("gid").agg(F.count("*").alias("pairs"), F.sum(F.expr("cast(a * 31 + b * 17 + c * 7 + d AS bigint)")).alias("mark"))


@query(f"""WITH {RING} SELECT x.gid, x.n, x.a u, CAST(y.v AS INT) v FROM pts x, LATERAL (SELECT unnest(range(x.a + 1, x.n)) v) y
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.gid = x.gid AND e.u = x.a AND e.v = y.v)""")
def non_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.non_edges(C.ring(spark, sf_dir))


C4_LIST = """half AS MATERIALIZED (SELECT x.gid, x.u a, x.v b, y.v c FROM adj x JOIN adj y ON y.gid = x.gid AND y.u = x.v WHERE x.v > x.u AND y.v > x.u),
cyc AS MATERIALIZED (SELECT p.gid, p.a, p.b, p.c, q.b d FROM half p JOIN half q ON q.gid = p.gid AND q.a = p.a AND q.c = p.c WHERE p.b < q.b)"""


@query(f"WITH {RING}, {ADJ}, {C4_LIST} SELECT gid, a, b, c, d FROM cyc")
def c4_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-cycles a-b-c-d in canonical form: least vertex first, b < d."""
    return G.c4_cycles(C.ring(spark, sf_dir))


NUMBERED = f"""{C4_LIST},
num AS (SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY a, b, c, d) i, [a, b, c, d] vs,
  [least(a,b) || '-' || greatest(a,b), least(b,c) || '-' || greatest(b,c), least(c,d) || '-' || greatest(c,d), least(a,d) || '-' || greatest(a,d)] es FROM cyc),
prs AS (SELECT x.gid, x.i, y.i j, len(list_intersect(x.vs, y.vs)) shared_vertices, len(list_intersect(x.es, y.es)) shared_edges FROM num x JOIN num y ON x.gid = y.gid AND x.i < y.i)"""


@query(f"WITH {RING}, {ADJ}, {NUMBERED} SELECT gid, count(*) pairs FROM prs GROUP BY gid")
def cycle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cycle_pairs(C.ring(spark, sf_dir)).groupBy("gid").agg(F.count("*").alias("pairs"))


@query(f"WITH {RING}, {ADJ}, {NUMBERED} SELECT gid, shared_vertices, shared_edges, count(*) pairs FROM prs GROUP BY ALL")
def cycle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cycle_pairs(C.ring(spark, sf_dir)).groupBy("gid", "shared_vertices", "shared_edges").agg(F.count("*").alias("pairs"))


APSP = """walk AS (SELECT gid, n, u, v, 1 d FROM adj UNION SELECT w.gid, w.n, w.u, a.v, w.d + 1 FROM walk w JOIN adj a ON a.gid = w.gid AND a.u = w.v WHERE w.d < w.n AND w.d < 12 AND a.v <> w.u),
dist AS (SELECT gid, u, v, min(d) d FROM walk GROUP BY ALL)"""


@query(f"WITH RECURSIVE {RING}, {ADJ}, {APSP} SELECT gid, u, v, d FROM dist")
def apsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all ordered pairs of vertices."""
    return G.distances(C.ring(spark, sf_dir)).select("gid", "u", "v", "d")


@query(f"""WITH RECURSIVE {RING}, {ADJ}, {APSP}, {NUMBERED},
vx AS (SELECT gid, i, unnest(vs) x FROM num),
pd AS (SELECT p.gid, p.i, p.j, min(CASE WHEN a.x = b.x THEN 0 ELSE d.d END) distance FROM prs p JOIN vx a ON a.gid = p.gid AND a.i = p.i JOIN vx b ON b.gid = p.gid AND b.i = p.j
  LEFT JOIN dist d ON d.gid = p.gid AND d.u = a.x AND d.v = b.x GROUP BY ALL)
SELECT gid, distance, count(*) pairs FROM pd GROUP BY ALL""")
def cycle_pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance between the vertices of two four-cycles, by pairs."""
    return K.cycle_pairs(C.ring(spark, sf_dir)).groupBy("gid", "distance").agg(F.count("*").alias("pairs"))
