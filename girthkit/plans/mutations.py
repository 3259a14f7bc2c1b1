"""Queries on candidate families. Families whose rows are many are returned as
counts and order-free marks a graph, which pin every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girthkit.operators import graphs as G
from girthkit.operators import moves as V
from girthkit.operators import mutations as M
from girthkit.plans.cycles import LOADS
from girthkit.plans.primitives import OK
from girthkit.plans.registry import query
from girthkit.sources import corpus as C

RING, ADJ, DEG = C.RING_SQL, C.ADJ_SQL, C.DEG_SQL
#: The mark of a row: a sum over its edges that tells rows apart in total.
MARK_SQL = "CAST(sum({m}) AS BIGINT) mark"


def _mark(moves: DataFrame) -> DataFrame:
    part = lambda c, k: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda t, e: t + (e["u"].cast("long") * 64 + e["v"]) * (e["u"].cast("long") * 64 + e["v"] + k))
    return moves.groupBy("gid").agg(F.count("*").alias("moves"), F.sum(part("removed", 1) + part("added", 7) * 3).alias("mark"))


def _e(a: str, b: str) -> str:
    return f"(least({a}, {b}) * 64 + greatest({a}, {b}))"


def _term(removed: list[str], added: list[str]) -> str:
    return " + ".join([f"{x} * ({x} + 1)" for x in removed] + [f"3 * {x} * ({x} + 7)" for x in added])


def _no(a: str, b: str, g: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM e z WHERE z.gid = {g} AND z.u = least({a}, {b}) AND z.v = greatest({a}, {b}))"


GOOD = f"WITH RECURSIVE {RING}, {ADJ}, {OK}, oe AS (SELECT e.* FROM e JOIN ok ON ok.gid = e.gid)"
DISJOINT = "x.u <> y.u AND x.u <> y.v AND x.v <> y.u AND x.v <> y.v"


@query(f"""{GOOD}, p AS (SELECT x.gid, x.u a, x.v b, unnest([[y.u, y.v], [y.v, y.u]]) w FROM oe x JOIN oe y ON x.gid = y.gid AND (x.u, x.v) < (y.u, y.v) WHERE {DISJOINT}),
q AS (SELECT gid, a, b, w[1] c, w[2] d FROM p)
SELECT gid, count(*) moves, {MARK_SQL.format(m=_term([_e('a', 'b'), _e('c', 'd')], [_e('a', 'c'), _e('b', 'd')]))} FROM q WHERE {_no('a', 'c', 'q.gid')} AND {_no('b', 'd', 'q.gid')} GROUP BY gid""")
def mut_two_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mark(M.two_switch(_good(spark, sf_dir)))


@query(f"""WITH {RING}, {ADJ}, {DEG}, q AS (SELECT x.gid, x.u a, x.v b, CAST(t.a AS INT) t FROM adj x JOIN deg d ON d.gid = x.gid AND d.u = x.v AND d.d >= 4 JOIN pts t ON t.gid = x.gid WHERE t.a <> x.u AND t.a <> x.v)
SELECT gid, count(*) moves, {MARK_SQL.format(m=_term([_e('a', 'b')], [_e('a', 't')]))} FROM q WHERE {_no('a', 't', 'q.gid')} GROUP BY gid""")
def mut_endpoint_relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.relocation_marks(C.ring_bits(spark, sf_dir))


@query(f"""WITH {RING}, sz AS (SELECT gid, n, count(*) m FROM e GROUP BY gid, n), q AS (SELECT x.gid, x.a, y.a b FROM pts x JOIN pts y ON y.gid = x.gid AND y.a > x.a JOIN sz ON sz.gid = x.gid WHERE m - (3 * x.n + 1) // 2 < 6)
SELECT gid, count(*) moves, {MARK_SQL.format(m=_term([], [_e('a', 'b')]))} FROM q WHERE {_no('a', 'b', 'q.gid')} GROUP BY gid""")
def mut_edge_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mark(M.edge_add(C.ring(spark, sf_dir), 6))


@query(f"""WITH {RING}, {ADJ}, {DEG}, sz AS (SELECT gid, n, count(*) m FROM e GROUP BY gid, n), q AS (SELECT e.gid, e.u a, e.v b FROM e JOIN deg x ON x.gid = e.gid AND x.u = e.u AND x.d >= 4 JOIN deg y ON y.gid = e.gid AND y.u = e.v AND y.d >= 4 JOIN sz ON sz.gid = e.gid WHERE m > (3 * e.n + 1) // 2)
SELECT gid, count(*) moves, {MARK_SQL.format(m=_term([_e('a', 'b')], []))} FROM q GROUP BY gid""")
def mut_edge_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mark(M.edge_remove(C.ring(spark, sf_dir)))


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the admissible graphs, kept, as families read them many times."""
    return G.admissible_edges(C.ring(spark, sf_dir)).persist()


def _load4(e: DataFrame) -> DataFrame:
    return M.load_of(G.c4_cycles(e)).persist()


@query()
def mut_c8_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-switches that take most cycles of length eight, 32 a graph."""
    return V.guided(C.ring_bits(spark, sf_dir), "two_switch", 8, 32)


@query()
def mut_c8_relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relocations of edges on cycles of length eight, 32 a graph."""
    return V.guided(C.ring_bits(spark, sf_dir), "c8_relocate", 8, 32)


@query()
def mut_vertex_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _good(spark, sf_dir)
    load = _load4(e)
    return M.vertex_rewire(e, load, 2, 32).unionByName(M.vertex_rewire(e, load, 3, 32))


@query()
def mut_coupled_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of loaded edges at a vertex, switched with two disjoint edges from
    anywhere: four edges for four, 32 a graph."""
    e = _good(spark, sf_dir)
    return M.coupled_switch(e, _load4(e), 32)


@query()
def mut_slack1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _good(spark, sf_dir)
    return M.slack(e, _load4(e), 1, 32, 8)


@query()
def mut_slack2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _good(spark, sf_dir)
    return M.slack(e, _load4(e), 2, 32, 8)


@query(f"""{GOOD}, q AS (SELECT x.gid, x.n, x.a, y.a b, z.a c FROM pts x JOIN ok ON ok.gid = x.gid JOIN pts y ON y.gid = x.gid AND y.a > x.a JOIN pts z ON z.gid = x.gid AND z.a > y.a)
SELECT gid, count(*) moves, {MARK_SQL.format(m=_term([], [_e('a', 'n'), _e('b', 'n'), _e('c', 'n')]))} FROM q GROUP BY gid""")
def grow_attach3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mark(M.grow(_good(spark, sf_dir), "attach3"))


@query(f"""{GOOD}, q AS (SELECT x.gid, x.n, x.u a, x.v b, w.a w FROM oe x JOIN pts w ON w.gid = x.gid WHERE w.a <> x.u AND w.a <> x.v)
SELECT gid, count(*) moves, {MARK_SQL.format(m=_term([_e('a', 'b')], [_e('a', 'n'), _e('b', 'n'), _e('w', 'n')]))} FROM q GROUP BY gid""")
def grow_split_spoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mark(M.grow(_good(spark, sf_dir), "split_spoke"))


PAIRED = f"{GOOD}, pr AS (SELECT x.gid, x.n, x.u a, x.v b, y.u c, y.v d FROM oe x JOIN oe y ON x.gid = y.gid AND (x.u, x.v) < (y.u, y.v) WHERE {DISJOINT})"


@query(f"{PAIRED} SELECT gid, count(*) moves, {MARK_SQL.format(m=_term([_e('a', 'b'), _e('c', 'd')], [_e(x, 'n') for x in 'abcd']))} FROM pr GROUP BY gid")
def grow_double_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mark(M.grow(_good(spark, sf_dir), "double_hub"))


@query(f"""{PAIRED}, k AS (SELECT gid, n, a, b, c, d, unnest([[a,c,b,d],[a,d,b,c],[b,c,a,d],[b,d,a,c]]) w FROM pr), q AS (SELECT gid, n, a, b, c, d, w[1] p, w[2] q, w[3] r, w[4] s, unnest([w[1], w[2]]) t FROM k)
SELECT gid, count(*) moves, {MARK_SQL.format(m=_term([_e('a', 'b'), _e('c', 'd')], [_e('p', 'q'), _e('r', 'n'), _e('s', 'n'), _e('t', 'n')]))} FROM q WHERE {_no('p', 'q', 'q.gid')} GROUP BY gid""")
def grow_switch_spoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mark(M.grow(_good(spark, sf_dir), "switch_spoke"))


def _after(spark: SparkSession, sf_dir: str, moves: DataFrame, e: DataFrame, grown: int) -> DataFrame:
    """Parents, their moved graphs, and how many of these keep degree 3."""
    new = M.applied(e, moves, grown)
    d = G.degrees(new.select("gid", "n", "u", "v")).groupBy("gid").agg(F.min("d").alias("min_degree"))
    per = new.groupBy("gid", "parent").agg(F.count("*").alias("m")).join(d, "gid")
    return per.groupBy(F.col("parent").alias("gid")).agg(F.count("*").alias("children"), F.sum("m").alias("edges"), F.count_if(F.col("min_degree") >= 3).alias("legal"))


@query(f"""{GOOD}, k AS (SELECT oe.gid, x.d >= 4 AND y.d >= 4 good, count(*) OVER (PARTITION BY oe.gid) m FROM oe JOIN deg x ON x.gid = oe.gid AND x.u = oe.u JOIN deg y ON y.gid = oe.gid AND y.u = oe.v)
SELECT gid, count(*) children, CAST(sum(m - 1) AS BIGINT) edges, count(*) FILTER (WHERE good) legal FROM k GROUP BY gid""")
def apply_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single edge taken away, applied, and held against degree 3."""
    e = _good(spark, sf_dir)
    moves = M._move(e, "drop", [("u", "v")], [])
    return _after(spark, sf_dir, moves, e, 0)


@query(f"""{GOOD}, k AS (SELECT x.gid, count(*) OVER (PARTITION BY x.gid) // (any_value(x.n) OVER (PARTITION BY x.gid) - 2) m FROM oe x JOIN pts w ON w.gid = x.gid WHERE w.a <> x.u AND w.a <> x.v)
SELECT gid, count(*) children, CAST(sum(m + 2) AS BIGINT) edges, count(*) legal FROM k GROUP BY gid""")
def apply_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split spoke, applied: one vertex and two edges more."""
    return V.spoked(C.ring_bits(spark, sf_dir))
