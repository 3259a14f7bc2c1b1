"""Least hitting sets of any number of sets, against trying all."""

import random
from itertools import combinations

from girthkit.operators import cycles as K
from girthkit.operators import graphs as G
from girthkit.sources import corpus as C


def brute(sets, items):
    return next(k for k in range(items + 1) if any(all(s & sum(1 << x for x in c) for s in sets) for c in combinations(range(items), k)))


def test_least_hitting_set():
    assert K.least_hitting_set([1 << k for k in range(21)]) == 21
    assert K.least_hitting_set([]) == 0
    rng = random.Random(7)
    for _ in range(120):
        items = rng.randint(4, 11)
        sets = [sum(1 << x for x in rng.sample(range(items), rng.randint(1, 4))) for _ in range(rng.randint(1, 40))]
        assert K.least_hitting_set(sets) == brute(sets, items)


def test_no_graph_is_left_out(spark, sf):
    ring = G.admissible_edges(C.ring(spark, sf))
    cycles = K.witnesses(ring, 4).persist()
    rows = K.hitting_numbers(cycles).collect()
    assert len(rows) == 36 and max(r.cycles for r in rows) > 20
    assert all(r.tau_edge is not None and 1 <= r.tau_vertex <= r.tau_edge <= r.cycles for r in rows)
    found = {}
    for r in cycles.collect():
        found.setdefault(r.gid, []).append(sum(1 << v for v in r.vertices))
    for r in sorted(rows, key=lambda r: -r.cycles)[:3]:
        few = lambda k: any(all(s & sum(1 << x for x in c) for s in found[r.gid]) for c in combinations(range(24), k))
        if r.tau_vertex <= 5:
            assert few(r.tau_vertex) and not few(r.tau_vertex - 1)
