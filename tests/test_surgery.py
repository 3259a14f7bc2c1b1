"""Guided families that rank all plans of a graph, on graphs known by heart."""

import pytest

from girthkit.operators import graphs as G
from girthkit.operators import mutations as M
from girthkit.sources import corpus as C
from tests.test_graphs import frame

CUBE = (8, [(0, 1), (1, 2), (2, 3), (0, 3), (4, 5), (5, 6), (6, 7), (4, 7), (0, 4), (1, 5), (2, 6), (3, 7)])


def moved(m):
    return {tuple(x) for x in m.removed}, {tuple(x) for x in m.added}


def after(edges, m):
    gone, new = moved(m)
    return (set(edges) - gone) | new


@pytest.fixture(scope="module")
def ring(spark, sf):
    return G.admissible_edges(C.ring(spark, sf)).persist()


@pytest.fixture(scope="module")
def load(ring):
    return M.load_of(G.c4_cycles(ring)).persist()


@pytest.fixture(scope="module")
def parents(ring):
    out = {}
    for x in ring.collect():
        out.setdefault(x.gid, set()).add((x.u, x.v))
    return out


def degrees(edges):
    ends = [x for e in edges for x in e]
    return {v: ends.count(v) for v in ends}


def test_coupled_switch_moves_four_edges_of_any_place(parents, ring, load):
    hot = {}
    for x in load.collect():
        hot.setdefault(x.gid, set()).add((x.u, x.v))
    rows = M.coupled_switch(ring, load, 32).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.coupled_switch(ring, load, 32).collect()))
    off = 0
    for m in rows:
        gone, new = moved(m)
        assert len(gone) == len(new) == 4 and gone <= parents[m.gid] and not new & parents[m.gid] and all(u < v for u, v in new)
        assert degrees(after(parents[m.gid], m)) == degrees(parents[m.gid]) and m.family == "coupled_switch2"
        off += bool(gone - hot[m.gid])
    assert off and {m.gid for m in rows} == set(parents)
    assert len({(m.gid, str(m.removed), str(m.added)) for m in rows}) == len(rows)


def test_coupled_switch_finds_all(spark):
    """The cube's moves, counted by trying every four edges."""
    e = frame(spark, {1: CUBE})
    edges = set(CUBE[1])
    near = {v: {a + b - v for a, b in edges if v in (a, b)} for v in range(8)}
    want = set()
    for h in near:
        for a in near[h]:
            for b in near[h] - {a}:
                rest = [x for x in edges if not {h, a, b} & set(x)]
                for p in rest:
                    for q in rest:
                        if set(p) & set(q):
                            continue
                        for p1, p2 in (p, p[::-1]):
                            for q1, q2 in (q, q[::-1]):
                                new = {tuple(sorted(x)) for x in ((h, p1), (a, p2), (h, q1), (b, q2))}
                                if len(new) == 4 and not new & edges:
                                    want.add((frozenset({tuple(sorted((h, a))), tuple(sorted((h, b))), p, q}), frozenset(new)))
    load = M.load_of(G.c4_cycles(e))
    got = {tuple(map(frozenset, moved(m))) for m in M.coupled_switch(e, load, 10**6).collect()}
    assert got == want and want


def test_slack_serves_cubic_donors(spark):
    """The cube has no vertex of degree 4: every move was lost."""
    e = frame(spark, {1: CUBE})
    load = M.load_of(G.c4_cycles(e))
    for k in (1, 2):
        rows = M.slack(e, load, k, 50, 9).collect()
        assert len(rows) == 50
        for m in rows:
            gone, new = moved(m)
            assert len(gone) == k and len(new) == k + 1 and gone <= set(CUBE[1]) and not new & set(CUBE[1])
            assert min(degrees(after(CUBE[1], m)).values()) >= 3
    assert M.slack(e, load, 1, 50, 0).count() == 0


def test_slack_finds_all(spark):
    e = frame(spark, {1: CUBE})
    edges = set(CUBE[1])
    free = {v: [t for t in range(8) if t != v and tuple(sorted((v, t))) not in edges] for v in range(8)}
    load = M.load_of(G.c4_cycles(e))
    cyc = [{tuple(sorted(p)) for p in zip(c, c[1:] + c[:1])} for c in ([r.a, r.b, r.c, r.d] for r in G.c4_cycles(e).collect())]
    on = {x: {i for i, c in enumerate(cyc) if x in c} for x in edges}
    pair = lambda a, b: tuple(sorted((a, b)))
    one = {(frozenset({x}), frozenset({pair(s, t), pair(d, w)})) for x in edges for s, d in (x, x[::-1]) for t in free[s] for w in free[d]}
    two = set()
    for x in edges:
        for y in edges - {x}:
            for s1, d1 in (x, x[::-1]):
                for s2, d2 in (y, y[::-1]):
                    if d1 != d2 and d2 in free[d1] and len(on[x] | on[y]) >= 2:
                        two |= {(frozenset({x, y}), frozenset(new)) for t1 in free[s1] for t2 in free[s2] if len(new := {pair(d1, d2), pair(s1, t1), pair(s2, t2)}) == 3}
    for k, want in ((1, one), (2, two)):
        got = {tuple(map(frozenset, moved(m))) for m in M.slack(e, load, k, 10**6, 9).collect()}
        assert got == want and want


def test_vertex_rewire_ranks_all_vertices(spark, parents, ring, load):
    """Every graph's first move covers as many cycles as any two loaded edges
    with a common end and donors of degree 4 can."""
    on, best = {}, {}
    for x in load.collect():
        on.setdefault(x.gid, {})[x.u, x.v] = set(x.on)
    for gid, edges in parents.items():
        d = degrees(edges)
        n = len(d)
        for x, a in on.get(gid, {}).items():
            for y, b in on[gid].items():
                h = set(x) & set(y)
                if x < y and h and all(d[v] >= 4 for v in {*x, *y} - h) and len(a | b) >= 2 and n - 1 - d[h.pop()] >= 2:
                    best[gid] = max(best.get(gid, 0), len(a | b))
    rows = M.vertex_rewire(ring, load, 2, 32).collect()
    got = {m.gid: m.coverage for m in rows if m.place == 1}
    assert got == best and best
    for m in rows:
        gone, new = moved(m)
        assert gone <= parents[m.gid] and not new & parents[m.gid] and min(degrees(after(parents[m.gid], m)).values()) >= 3
