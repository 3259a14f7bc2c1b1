"""Half paths against the search, rows of bits against edges, and how often the
queries by half paths shuffle."""

import random

import pytest

from girthkit.operators import cycles as K
from girthkit.operators import halves as H
from girthkit.plans import registry
from girthkit.sources import corpus as C

registry.load()
SCHEMA = "gid long, n int, u int, v int"


def shuffles(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Aggregate") + plan.count("Join")


@pytest.fixture(scope="module")
def odd(spark):
    """Sparse and dense graphs of odd orders, up to 64; one without cycles, one
    with a vertex that has no edge."""
    rng = random.Random(5)
    rows = []
    for gid, (n, share) in enumerate([(4, 1), (8, 1), (9, 0.7), (13, 0.4), (31, 0.1), (32, 0.1), (33, 0.1), (64, 0.04)]):
        rows += [(gid, n, u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < share]
    rows += [(100, 64, min(u, (u + 8) % 64), max(u, (u + 8) % 64)) for u in range(64)]  # eight rings of eight
    rows += [(101, 5, 0, 1), (101, 5, 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).persist()


def test_lengths_4_to_8(odd):
    lengths = (4, 5, 6, 7, 8)
    got = {(r.gid, r.length): r.observed for r in H.count_lengths(C.nested(odd), lengths).collect()}
    for r in C.nested(odd).collect():
        near = K.neighbour_masks(r.n, r.edges)
        assert [got[r.gid, x] for x in lengths] == [K.search(near, x)[0] for x in lengths], r.gid
    assert got[100, 8] == 8 and got[101, 4] == 0


def test_parts_of_starts(odd, monkeypatch):
    batches = C.nested(odd.filter("n < 33")).toArrow().to_batches()
    whole = [H.spectrum(H.Masks(b), (5, 8)) for b in batches]
    monkeypatch.setattr(H, "WALKS", 50)
    for b, want in zip(batches, whole):
        got = H.spectrum(H.Masks(b), (5, 8))
        assert all((got[x] == want[x]).all() for x in (5, 8))


def test_bits_are_edges(spark, odd):
    """In any direction, with loops and repeats."""
    pairs = odd.selectExpr("gid", "n", "u a", "v b").union(odd.selectExpr("gid", "n", "v", "u")).union(odd.selectExpr("gid", "n", "u", "u"))
    got = H.count_lengths(C.graph_bits(pairs, 64), (4, 7))
    assert sorted(got.collect()) == sorted(H.count_lengths(C.nested(odd), (4, 7)).collect())
    beyond = spark.createDataFrame([(1, 5, 0, 5)], "gid long, n int, a int, b int")
    with pytest.raises(Exception, match="beyond the order"):
        C.graph_bits(beyond, 64).collect()


def test_ring_bits_with_nulls(spark, sf, tmp_path):
    """Line items without part or order: rings stay, rows without order go."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").limit(500)
    items = items.withColumn("l_partkey", items.l_partkey + 0).selectExpr("* EXCEPT (l_partkey, l_orderkey)", "if(l_orderkey div 5 = 2, null, l_partkey) l_partkey", "if(l_orderkey = 3, null, l_orderkey) l_orderkey")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    counts = [H.count_lengths(rows, (4, 8)) for rows in (C.ring_bits(spark, str(tmp_path)), C.nested(C.ring(spark, str(tmp_path))))]
    got, want = (sorted(c.collect()) for c in counts)
    assert got == want and len(got) > 20


@pytest.mark.parametrize("name", ["cycle_spectrum", "cycle8_paths", "apply_growth", "mut_c8_relocate", "mut_endpoint_relocate", "mut_c8_switch"])
def test_one_shuffle_a_query(spark, sf, name):
    """Rows of paths or moves are not shuffled: graphs are, once."""
    assert shuffles(registry.QUERIES[name](spark, sf)) == 1
