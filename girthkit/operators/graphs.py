"""Declarative graph operators: degrees, connectedness, triangles, four-cycles,
pairs of edges. Every function takes edges (gid, n, u, v) unless it says so.
All joins are equi-joins on gid and a vertex, so they spread over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girthkit.functions.scalar import graph_hash
from girthkit.sources.corpus import adjacency, nested, vertices


def degrees(edges: DataFrame) -> DataFrame:
    """(gid, n, u, d) for every vertex, 0 for isolated ones."""
    ends = edges.select("gid", "n", F.explode(F.array("u", "v")).alias("u"))
    counted = ends.groupBy("gid", "n", "u").agg(F.count("*").alias("d"))
    return vertices(edges).join(counted, ["gid", "n", "u"], "left").withColumn("d", F.coalesce("d", F.lit(0)))


def degree_text(edges: DataFrame) -> DataFrame:
    """(gid, n, sequence, compact): `3,3,4` ascending, and `3^2,4^1`."""
    counted = degrees(edges).groupBy("gid", "n", "d").agg(F.count("*").alias("k"))
    runs = F.array_sort(F.collect_list(F.struct("d", "k")))
    out = counted.groupBy("gid", "n").agg(runs.alias("r"))
    return out.select(
        "gid", "n",
        F.array_join(F.flatten(F.transform("r", lambda x: F.array_repeat(x["d"].cast("string"), x["k"].cast("int")))), ",").alias("sequence"),
        F.array_join(F.transform("r", lambda x: F.concat(x["d"].cast("string"), F.lit("^"), x["k"].cast("string"))), ",").alias("compact"),
    )


def masks(edges: DataFrame) -> DataFrame:
    """(gid, n, u, mask): neighbours as bits of a long; orders beyond 63 are an
    error, for a shift by more would wrap."""
    bit = F.when(F.col("n") <= 63, F.expr("shiftleft(1L, v)")).otherwise(F.raise_error(F.lit("vertex sets as bits end at order 63")).cast("long"))
    return adjacency(edges).groupBy("gid", "n", "u").agg(F.bit_or(bit).alias("mask"))


def connected(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """(gid, n, connected). Closure of vertex 0 over bit masks held in one
    array a graph: each round doubles the reach, so six rounds do for order
    63; no shuffle after the first grouping."""
    by = masks(edges).groupBy("gid", "n").agg(F.map_from_entries(F.collect_list(F.struct("u", "mask"))).alias("m"))
    own = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda u: F.coalesce(F.element_at("m", u), F.lit(0).cast("long")).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), u)))
    by = by.select("gid", "n", own.alias("r"))
    by = by.withColumn("r", F.expr(f"""aggregate(sequence(1, {rounds}), r, (a, k) -> transform(a, x ->
        aggregate(a, struct(0 AS i, 0L AS s), (t, y) -> struct(t.i + 1 AS i, if(getbit(x, t.i) = 1, t.s | y, t.s) AS s), t -> t.s)))"""))
    return by.select("gid", "n", (F.bit_count(F.col("r")[0]) == F.col("n")).alias("connected"))


def admissible(edges: DataFrame, low: int = 4, high: int = 63, least: int = 3) -> DataFrame:
    """(gid, n, min_degree, admissible, reason); the first failing rule names
    the reason: order, disconnected, degree."""
    d = degrees(edges).groupBy("gid", "n").agg(F.min("d").alias("min_degree"))
    out = d.join(connected(edges.filter(F.col("n").between(low, high))), ["gid", "n"], "left")
    reason = F.when((F.col("n") < low) | (F.col("n") > high), "order").when(~F.col("connected"), "disconnected").when(F.col("min_degree") < least, "degree").otherwise("none")
    return out.select("gid", "n", "min_degree", (reason == "none").alias("admissible"), reason.alias("reason"))


def admissible_edges(edges: DataFrame) -> DataFrame:
    """The edges of admissible graphs. Minimum degree first: it is the cheap
    and selective rule, connectedness is asked of what is left."""
    d = degrees(edges).groupBy("gid").agg(F.min("d").alias("m")).filter("m >= 3").select("gid")
    left = edges.join(d, "gid", "left_semi")
    return left.join(connected(left).filter("connected").select("gid"), "gid", "left_semi")


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(gid, u, w, k) for pairs u < w with k common neighbours, k >= 1."""
    a = adjacency(edges)
    x, y = a.select("gid", "u", "v"), a.select("gid", F.col("u").alias("w"), "v")
    return x.join(y, ["gid", "v"]).filter("u < w").groupBy("gid", "u", "w").agg(F.count("*").alias("k"))


def c4_count(edges: DataFrame) -> DataFrame:
    """(gid, c4): each four-cycle has two diagonals, so half the pairs of
    common neighbours; an odd sum is an error."""
    pairs = common_neighbours(edges).groupBy("gid").agg(F.sum(F.expr("k * (k - 1) div 2")).alias("t"))
    graphs = edges.select("gid").distinct()
    odd = F.when(F.col("t") % 2 == 1, F.raise_error(F.lit("odd number of diagonals")).cast("long"))
    return graphs.join(pairs, "gid", "left").select("gid", F.coalesce(odd, F.expr("t div 2"), F.lit(0).cast("long")).alias("c4"))


def triangles(edges: DataFrame) -> DataFrame:
    """(gid, a, b, c), a < b < c."""
    x = edges.select("gid", F.col("u").alias("a"), F.col("v").alias("b"))
    y = edges.select("gid", F.col("u").alias("b"), F.col("v").alias("c"))
    z = edges.select("gid", F.col("u").alias("a"), F.col("v").alias("c"))
    return x.join(y, ["gid", "b"]).join(z, ["gid", "a", "c"]).select("gid", "a", "b", "c")


def c4_cycles(edges: DataFrame) -> DataFrame:
    """(gid, a, b, c, d): every four-cycle a-b-c-d once, a its least vertex and
    b < d. Diagonals a-c and b-d; each cycle has one with its least vertex."""
    adj = adjacency(edges)
    paths = adj.select("gid", F.col("u").alias("a"), F.col("v").alias("b")).join(adj.select("gid", F.col("u").alias("b"), F.col("v").alias("c")), ["gid", "b"]).filter("a < b AND a < c")
    other = paths.select("gid", "a", "c", F.col("b").alias("d"))
    return paths.join(other, ["gid", "a", "c"]).filter("b < d").select("gid", "a", "b", "c", "d")


def disjoint_edge_pairs(edges: DataFrame) -> DataFrame:
    """(gid, n, a, b, c, d): pairs of edges a-b and c-d without a common end,
    each once."""
    x = edges.select("gid", "n", F.col("u").alias("a"), F.col("v").alias("b"))
    y = edges.select("gid", F.col("u").alias("c"), F.col("v").alias("d"))
    return x.join(y, "gid").filter("(a < c OR (a = c AND b < d)) AND a <> c AND a <> d AND b <> c AND b <> d")


def non_edges(edges: DataFrame) -> DataFrame:
    """(gid, n, u, v), u < v, not joined."""
    u = vertices(edges)
    pairs = u.select("gid", "n", "u", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("v")).filter("u < v")
    return pairs.join(edges.select("gid", "u", "v"), ["gid", "u", "v"], "left_anti")


def c4_forced_edges(edges: DataFrame) -> DataFrame:
    """(gid, u, v): non-edges that would close a four-cycle, being the ends of
    a path of three edges."""
    adj = adjacency(edges).select("gid", "u", "v")
    ab = adj.toDF("gid", "a", "b")
    bc = adj.toDF("gid", "b", "c")
    cd = adj.toDF("gid", "c", "d")
    ends = ab.join(bc, ["gid", "b"]).filter("a <> c").join(cd, ["gid", "c"]).filter("d <> b AND a < d")
    return ends.select("gid", F.col("a").alias("u"), F.col("d").alias("v")).distinct().join(edges.select("gid", "u", "v"), ["gid", "u", "v"], "left_anti")


def distances(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(gid, n, u, v, d) for ordered pairs that are joined by a path, u <> v.
    Breadth first over bit masks: one row a vertex holds what it reaches in d
    steps, a round is one map over the graph's array."""
    by = masks(edges).groupBy("gid", "n").agg(F.map_from_entries(F.collect_list(F.struct("u", "mask"))).alias("m"))
    one = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda u: F.coalesce(F.element_at("m", u), F.lit(0).cast("long")))
    by = by.select("gid", "n", one.alias("nb"))
    rows = by.select("gid", "n", "nb", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("u"))
    # per source: layers of vertices first reached after 1, 2, ... steps
    step = """aggregate(sequence(1, n), struct(shiftleft(1L, u) AS seen, shiftleft(1L, u) AS now, cast(array() AS array<bigint>) AS layers),
        (s, i) -> if(s.now = 0, s, named_struct('seen', s.seen | {grow}, 'now', {grow} & ~s.seen, 'layers', concat(s.layers, array({grow} & ~s.seen)))),
        s -> s.layers)"""
    grow = "aggregate(nb, struct(0 AS i, 0L AS s), (t, y) -> struct(t.i + 1 AS i, if(getbit(s.now, t.i) = 1, t.s | y, t.s) AS s), t -> t.s)"
    rows = rows.select("gid", "n", "u", F.expr(step.format(grow=grow)).alias("layers"))
    rows = rows.select("gid", "n", "u", F.posexplode("layers").alias("p", "layer")).filter("layer <> 0")
    rows = rows.select("gid", "n", "u", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("v"), "p", "layer")
    return rows.filter("getbit(layer, v) = 1").select("gid", "n", "u", "v", (F.col("p") + 1).alias("d"))


def hashed(edges: DataFrame) -> DataFrame:
    """(gid, n, m, edges, graph_hash)."""
    return nested(edges).select("gid", "n", F.size("edges").cast("long").alias("m"), "edges", graph_hash(F.col("edges"), F.col("n")).alias("graph_hash"))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first in an order; rows without a key all stay."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.filter(F.col(key).isNull()).unionByName(df.filter(F.col(key).isNotNull()).withColumn("_r", rank).filter("_r = 1").drop("_r"))
