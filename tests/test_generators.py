"""The four generators, and corpora that cannot be filled."""

import random

import pytest

from girthkit.operators import iso as I


def test_cycle_matching_stub_pairing():
    draw = random.Random(3)
    for n in (10, 11, 12, 13):
        for _ in range(20):
            near = I.GENERATORS["cycle_matching_stub_pairing"](n, draw)
            assert I.legal(near) and sorted(m.bit_count() for m in near) == [3] * (n - n % 2) + [4] * (n % 2)
            assert all(near[v] >> w & 1 for w in range(n) for v in range(n) if near[w] >> v & 1)
            assert n % 2 or all(near[v] >> (v + 1) % n & 1 for v in range(n))


def test_mixed_corpora_have_all_families_and_enough_graphs(spark):
    rows = I.distinct_graphs(spark, 200, 401, 10, 13).collect()
    assert len({r.graph_hash for r in rows}) == 200 and {r.generator for r in rows} == set(I.GENERATORS) and len(I.GENERATORS) == 4


def test_shortfall_is_an_error(spark):
    with pytest.raises(ValueError, match="distinct graphs in 1000 attempts"):
        I.distinct_graphs(spark, 5, 1, 4, 4)  # the complete graph alone is legal
