"""Known graphs, closed forms and agreement of independent counters."""

import itertools
import random
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from girthkit.functions.scalar import energy_columns
from girthkit.operators import cycles as K
from girthkit.operators import graphs as G
from girthkit.operators import iso as I
from girthkit.operators import mutations as M
from girthkit.sources import corpus as C
from girthkit.sources import records as R


def frame(spark, graphs):
    rows = [(gid, n, *e) for gid, (n, edges) in graphs.items() for e in edges]
    return spark.createDataFrame(rows, "gid long, n int, u int, v int")


def complete(n):
    return n, [(u, v) for u in range(n) for v in range(u + 1, n)]


K33 = (6, [(u, v) for u in range(3) for v in range(3, 6)])
PETERSEN = (10, [(i, (i + 1) % 5) if i < 4 else (0, 4) for i in range(5)] + [(i, i + 5) for i in range(5)] + [tuple(sorted((5 + i, 5 + (i + 2) % 5))) for i in range(5)])


def masks(graph):
    n, edges = graph
    return K.neighbour_masks(n, [{"u": u, "v": v} for u, v in edges])


def test_search_known_counts():
    assert K.search(masks(complete(4)), 4) == (3, True, 24)
    assert [K.search(masks(complete(5)), x)[0] for x in (3, 4, 5)] == [10, 15, 12]
    assert K.search(masks(complete(8)), 8)[0] == 2520
    assert K.search(masks(K33), 4)[0] == 9
    assert [K.search(masks(PETERSEN), x)[0] for x in (4, 5, 6, 8, 9)] == [0, 12, 10, 15, 20]
    assert K.search(masks(complete(6)), 4, cap=5)[:2] == (5, False)
    assert K.search(masks(complete(6)), 4, budget=7)[1:] == (False, 7)


def test_joins_agree_with_search(spark):
    graphs = {4: complete(4), 6: complete(6), 33: K33, 10: PETERSEN}
    e = frame(spark, graphs)
    c4 = {r.gid: r.c4 for r in G.c4_count(e).collect()}
    assert c4 == {gid: K.search(masks(g), 4)[0] for gid, g in graphs.items()}
    assert c4[6] == 3 * comb(6, 4)
    for length in (5, 6, 8):
        found = {r.gid: r["count"] for r in K.cycles_by_joins(e, length).groupBy("gid").count().collect()}
        assert found == {gid: k for gid, g in graphs.items() if (k := K.search(masks(g), length)[0])}
    assert G.c4_cycles(e).count() == sum(c4.values())


def test_connected_and_admissible(spark):
    two = (8, complete(4)[1] + [(u + 4, v + 4) for u, v in complete(4)[1]])
    e = frame(spark, {1: complete(4), 2: two, 3: (4, [(0, 1), (1, 2), (2, 3)])})
    got = {r.gid: (r.admissible, r.reason) for r in G.admissible(e).collect()}
    assert got == {1: (True, "none"), 2: (False, "disconnected"), 3: (False, "degree")}


def test_energy(spark):
    row = spark.createDataFrame([(8, 0, 0, 12), (4, 3, 48, 6)], "n int, t long, w long, m long")
    columns = [F.col(c) for c in "ntwm"]
    wide, narrow = (row.select(*energy_columns(*columns, 1, 16, cap)).collect() for cap in (4, 64))
    assert wide[0][1] == 5524
    assert narrow[1][0] == 3123 and 1 - Fraction(*narrow[1]) == Fraction(61, 64)


def test_even_cycles_by_pairs(spark):
    rng = random.Random(5)
    graphs = {1: complete(4), 2: complete(8), 3: PETERSEN}
    for gid in range(4, 30):
        n = rng.randint(4, 13)
        graphs[gid] = n, [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.45] or [(0, 1)]
    got = {r.gid: (r.c4, r.c6, r.c8) for r in K.count_evens(frame(spark, graphs), (4, 6, 8)).collect()}
    for gid, (n, edges) in graphs.items():
        near = K.neighbour_masks(n, [{"u": u, "v": v} for u, v in edges])
        assert got[gid] == tuple(K.search(near, x)[0] for x in (4, 6, 8))
    assert got[2] == (210, 1680, 2520)
    found = {r.gid: (r.total, r.pruned_at) for r in K.cascade(frame(spark, graphs), (4, 5, 8), 60).collect()}
    for gid, (n, edges) in graphs.items():
        near, total, stage = K.neighbour_masks(n, [{"u": u, "v": v} for u, v in edges]), 0, None
        for x in (4, 5, 8):
            if stage is None and x <= n:
                total += K.search(near, x)[0]
                stage = x if total > 60 else None
        assert found[gid] == (None if stage else total, stage)


def test_graph6(spark):
    e = frame(spark, {1: complete(4), 2: PETERSEN})
    lines = {r.gid: r.line for r in R.to_graph6(e).collect()}
    assert lines[1] == "C~"
    back = R.from_graph6(R.to_graph6(e))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))
    witness = spark.createDataFrame([(1, "ICOcbPcf_")], "gid long, line string")
    assert [r.c4 for r in G.c4_count(R.from_graph6(witness)).collect()] == [4]
    with pytest.raises(Exception, match="cut short"):
        R.from_graph6(spark.createDataFrame([(1, "I")], "gid long, line string")).collect()


def test_isomorphic():
    renamed = (10, [tuple(sorted(((u * 3) % 10, (v * 3) % 10))) for u, v in PETERSEN[1]])
    assert I.isomorphic(masks(PETERSEN), masks(renamed))
    prism = (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (0, 3), (1, 4), (2, 5)])
    assert not I.isomorphic(masks(K33), masks(prism))


def test_hitting_set():
    assert K.hitting_set([0b011, 0b110, 0b101]) == 2
    assert K.hitting_set([0b001, 0b011, 0b101]) == 1
    assert K.hitting_set([1 << k for k in range(21)]) is None
    assert K.hitting_set([]) == 0


def test_walk_and_generators_are_legal_and_repeatable(spark):
    near = masks(complete(8))
    assert I.legal(I.walk(near, 50, 3)) and I.walk(near, 50, 3) == I.walk(near, 50, 3)
    rows = I.attempts(spark, 400, 401, 10, 13).collect()
    assert {r.generator for r in rows if r.edges} == set(I.GENERATORS)
    assert rows == I.attempts(spark, 400, 401, 10, 13).collect()


def test_moves_are_legal(spark):
    e = frame(spark, {1: complete(5), 2: PETERSEN, 3: K33})
    edges = {r.gid: {(x.u, x.v) for x in e.filter(f"gid = {r.gid}").collect()} for r in e.select("gid").distinct().collect()}
    load = M.load_of(K.cycles_by_joins(e, 5))
    families = [M.two_switch(e), M.endpoint_relocate(e), M.edge_add(e, 5), M.vertex_rewire(e, load, 2, 8), M.slack(e, load, 1, 8, 9)]
    for moves in families:
        for m in moves.collect():
            own, gone, new = edges[m.gid], {tuple(x) for x in m.removed}, {tuple(x) for x in m.added}
            assert gone <= own and not new & own and all(u < v for u, v in new), m
    assert M.two_switch(e).filter("gid = 1").count() == 0


def test_corpora(spark, sf):
    ring = C.ring(spark, sf)
    assert ring.count() == 10006 and ring.select("gid").distinct().count() == 300
    assert G.c4_count(ring).agg({"c4": "sum"}).first()[0] == 4634
    assert G.triangles(ring).count() == 1923
    dense = C.dense(spark, sf)
    assert dense.count() == 3070 and G.c4_count(dense).agg({"c4": "sum"}).first()[0] == 39935


def test_orders_beyond_the_bits(spark):
    e = frame(spark, {1: complete(64), 2: complete(63), 3: complete(4)})
    got = {r.gid: (r.admissible, r.reason) for r in G.admissible(e).collect()}
    assert got == {1: (False, "order"), 2: (True, "none"), 3: (True, "none")}
    with pytest.raises(Exception, match="end at order 63"):
        G.connected(e).collect()
