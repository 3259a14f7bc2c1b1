"""Moves made within rows of graphs against the same families by joins."""

import random

import pytest

from girthkit.operators import cycles as K
from girthkit.operators import graphs as G
from girthkit.operators import moves as V
from girthkit.operators import mutations as M
from girthkit.plans.mutations import _after, _mark
from girthkit.sources import corpus as C


@pytest.fixture(scope="module")
def graphs(spark):
    """Admissible graphs of orders 6 to 33; a disconnected one, one with an end
    of degree 1, one without free pairs, and one that misses vertex 3."""
    rng = random.Random(11)
    rows = []
    for gid, n in enumerate([6, 8, 11, 12, 14, 33]):
        edges = {(u, u + 1) for u in range(n - 1)} | {(0, n - 1)}
        for a in [*range(n), 0, 1, n - 1]:
            if a in (0, 1, n - 1) or sum(a in e for e in edges) < 3:
                edges.add(rng.choice([(min(a, b), max(a, b)) for b in range(n) if b != a and (min(a, b), max(a, b)) not in edges]))
        rows += [(gid, n, u, v) for u, v in edges]
    four = [(u, v) for v in range(4) for u in range(v)]
    rows += [(20, 8, u + k, v + k) for u, v in four for k in (0, 4)]
    rows += [(21, 5, u, v) for u, v in [*four, (0, 4)]]
    rows += [(22, 4, u, v) for u, v in four]
    rows += [(23, 4, 0, 1), (23, 4, 1, 2), (23, 4, 0, 2)]
    return spark.createDataFrame(rows, "gid long, n int, u int, v int").persist()


@pytest.fixture(params=[V.MOVES, 100])
def parts(request, monkeypatch):
    monkeypatch.setattr(V, "MOVES", request.param)


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (sorted(x.select(*sorted(want.columns)).collect(), key=repr) for x in (got, want))
    assert got == want and got


def test_admissible(graphs):
    batch = C.nested(graphs).toArrow().combine_chunks().to_batches()[0]
    got = batch.column("gid").take(V.pa.array(V.Masks(batch).admissible())).to_pylist()
    assert sorted(got) == sorted(r.gid for r in G.admissible_edges(graphs).select("gid").distinct().collect())
    assert 20 not in got and 21 not in got and 22 in got


def test_relocation_marks(graphs, parts):
    same(V.relocation_marks(C.nested(graphs)), _mark(M.endpoint_relocate(graphs)))


@pytest.fixture(scope="module")
def joined(graphs):
    """All moves of both families by joins."""
    e = G.admissible_edges(graphs).filter("n < 13").persist()
    load = M.load_of(K.cycles_by_joins(e, 8)).persist()
    families = {"two_switch": M.two_switch(e), "c8_relocate": M.endpoint_relocate(e, load, "c8_relocate")}
    return {name: M.guided(moves, load, 1 << 20).collect() for name, moves in families.items()}


@pytest.mark.parametrize("family", ["two_switch", "c8_relocate"])
@pytest.mark.parametrize("keep", [7, 1 << 20])
def test_guided(graphs, joined, parts, family, keep):
    """All moves, and the first ones, where ties go by their texts."""
    got = V.guided(C.nested(graphs.filter("n < 13")), family, 8, keep).select(*joined[family][0].__fields__).collect()
    assert sorted(got, key=repr) == sorted((r for r in joined[family] if r.place <= keep), key=repr) and got


def test_guided_of_wide_masks(graphs):
    """A graph of order 33 in the batch makes masks of 64 bits for all."""
    rows = C.nested(graphs).coalesce(1).orderBy("gid")
    same(V.guided(rows, "two_switch", 8, 9).filter("n < 33"), V.guided(C.nested(graphs.filter("n < 33")), "two_switch", 8, 9))


def test_spoked(graphs, parts):
    e = G.admissible_edges(graphs)
    same(V.spoked(C.nested(graphs)), _after(graphs.sparkSession, "", M.grow(e, "split_spoke"), e, 1))
