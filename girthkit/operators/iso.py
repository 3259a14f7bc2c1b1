"""Isomorphism: refinement hashes, buckets of cheap invariants, exact classes,
and the seeded walks and generators of candidates."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girthkit.functions.scalar import graph_hash
from girthkit.operators.cycles import neighbour_masks
from girthkit.sources.corpus import nested


def wl_hash(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """(gid, wl): vertices are relabelled by hashes of their own and their
    neighbours' labels; the sorted labels of the last round are hashed. A graph
    is one row with its neighbour lists, so all rounds run in place."""
    ends = lambda x, near, far: F.transform(F.filter("edges", lambda e: e[near] == x), lambda e: e[far])
    near = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.concat(ends(x, "u", "v"), ends(x, "v", "u")))
    around = lambda labels, ns: F.array_join(F.array_sort(F.transform(ns, lambda w: F.get(labels, w))), ",")
    relabel = lambda labels, _: F.transform("near", lambda ns, i: F.sha2(F.concat(F.get(labels, i), F.lit("|"), around(labels, ns)).cast("binary"), 256))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform("near", lambda ns: F.size(ns).cast("string")), relabel)
    return nested(edges).withColumn("near", near).select("gid", F.sha2(F.array_join(F.array_sort(last), ",").cast("binary"), 256).alias("wl"))


def isomorphic(one: list[int], other: list[int]) -> bool:
    """Whether two graphs (neighbour masks) are the same up to names: vertices
    are matched in the order of a search, each with one of equal degree that
    agrees on all earlier neighbours."""
    n = len(one)
    if n != len(other) or sorted(m.bit_count() for m in one) != sorted(m.bit_count() for m in other):
        return False
    order: list[int] = []
    seen = 0
    while len(order) < n:
        best = max((v for v in range(n) if not seen >> v & 1), key=lambda v: ((one[v] & seen).bit_count(), one[v].bit_count(), -v))
        order.append(best)
        seen |= 1 << best
    image, used = {}, 0

    def match(k: int) -> bool:
        nonlocal used
        if k == n:
            return True
        v = order[k]
        fixed = [(image[w], one[v] >> w & 1) for w in order[:k]]
        for t in range(n):
            if used >> t & 1 or other[t].bit_count() != one[v].bit_count():
                continue
            if all((other[t] >> s & 1) == edge for s, edge in fixed):
                image[v] = t
                used |= 1 << t
                if match(k + 1):
                    return True
                used &= ~(1 << t)
        return False

    return match(0)


def classes(edges: DataFrame, buckets: DataFrame) -> DataFrame:
    """(gid, bucket, representative): the first graph of a bucket (by gid) that
    each graph is isomorphic to. Only graphs of one bucket (n, edges, WL hash)
    are compared, so a bucket is nearly always one class; a graph is held
    against one representative a class."""
    rows = nested(edges).join(buckets, "gid")

    def split(group: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, list[int]]] = []
        out = []
        for gid, n, pairs in group.sort_values("gid")[["gid", "n", "edges"]].itertuples(index=False):
            masks = neighbour_masks(int(n), pairs)
            for first, other in found:
                if isomorphic(other, masks):
                    break
            else:
                first = gid
                found.append((gid, masks))
            out.append((gid, group["bucket"].iloc[0], first))
        return pd.DataFrame(out, columns=["gid", "bucket", "representative"])

    return rows.groupBy("bucket").applyInPandas(split, "gid long, bucket string, representative long")


def legal(near: list[int]) -> bool:
    """Connected, and of minimum degree 3."""
    if any(m.bit_count() < 3 for m in near):
        return False
    seen, now = 1, 1
    while now:
        bit = now & -now
        now ^= bit
        new = near[bit.bit_length() - 1] & ~seen
        seen |= new
        now |= new
    return seen.bit_count() == len(near)


def walk(near: list[int], steps: int, seed: int) -> list[int]:
    """A blind walk: each step adds or takes away an edge drawn at random and
    stays legal."""
    draw, near, n = random.Random(seed), list(near), len(near)
    for _ in range(steps):
        u, v = draw.sample(range(n), 2)
        for x, y in ((u, v), (v, u)):
            near[x] ^= 1 << y
        if not legal(near):
            for x, y in ((u, v), (v, u)):
                near[x] ^= 1 << y
    return near


def edges_of(near: list[int]) -> list[dict]:
    return [{"u": u, "v": v} for u in range(len(near)) for v in range(u + 1, len(near)) if near[u] >> v & 1]


def _walks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(gid, n, edges_of(walk(neighbour_masks(int(n), pairs), int(steps), int(seed)))) for gid, n, pairs, steps, seed in frame[["gid", "n", "edges", "steps", "seed"]].itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["gid", "n", "edges"])


def legal_walks(edges: DataFrame, steps: int, seed: int) -> DataFrame:
    """(gid, n, edges) after a seeded walk from each graph."""
    rows = nested(edges).withColumns({"steps": F.lit(steps), "seed": F.xxhash64("gid", F.lit(seed))})
    return rows.mapInPandas(_walks, "gid long, n int, edges array<struct<u:int,v:int>>")


def random_regular(n: int, degree: int, draw: random.Random) -> list[int] | None:
    """Half edges paired at random; None if that makes a loop or a repeat."""
    ends = [v for v in range(n) for _ in range(degree)]
    draw.shuffle(ends)
    near = [0] * n
    for u, v in zip(ends[::2], ends[1::2]):
        if u == v or near[u] >> v & 1:
            return None
        near[u] |= 1 << v
        near[v] |= 1 << u
    return near


def random_mean(n: int, mean: float, draw: random.Random) -> list[int]:
    near = [0] * n
    for u in range(n):
        for v in range(u + 1, n):
            if draw.random() < mean / (n - 1):
                near[u] |= 1 << v
                near[v] |= 1 << u
    return near


def random_degrees(n: int, low: int, high: int, draw: random.Random) -> list[int] | None:
    """A graph with drawn degrees: highest joined to the next highest, then
    switched at random; None if the degrees have no graph."""
    left = [draw.randint(low, high) for _ in range(n)]
    if sum(left) % 2:
        left[0] += 1 if left[0] < n - 1 else -1
    near = [0] * n
    while any(left):
        order = sorted(range(n), key=lambda v: -left[v])
        top, need = order[0], left[order[0]]
        if need > sum(1 for v in order[1:] if left[v]):
            return None
        for v in [v for v in order[1:] if left[v]][:need]:
            near[top] |= 1 << v
            near[v] |= 1 << top
            left[v] -= 1
        left[top] = 0
    pairs = [(e["u"], e["v"]) for e in edges_of(near)]
    for _ in range(4 * len(pairs)):
        i, j = draw.sample(range(len(pairs)), 2)
        (a, b), (c, d) = pairs[i], pairs[j]
        if len({a, b, c, d}) == 4 and not near[a] >> c & 1 and not near[b] >> d & 1:
            for x, y in ((a, b), (c, d), (a, c), (b, d)):
                near[x] ^= 1 << y
                near[y] ^= 1 << x
            pairs[i], pairs[j] = (a, c), (b, d)
    return near


def paired(n: int, ends: list[int], draw: random.Random, near: list[int]) -> list[int] | None:
    """near, with ends joined one by one to a drawn end of another vertex that
    is not joined yet; None if there is none left for one."""
    near = [*near]
    draw.shuffle(ends)
    while ends:
        u = ends.pop()
        choices = [i for i, v in enumerate(ends) if u != v and not near[u] >> v & 1]
        if not choices:
            return None
        v = ends.pop(draw.choice(choices))
        near[u] |= 1 << v
        near[v] |= 1 << u
    return near


def cycle_matching(n: int, draw: random.Random, tries: int = 200) -> list[int] | None:
    """Even orders: a ring and a perfect matching of vertices it does not join."""
    ring = [1 << (v - 1) % n | 1 << (v + 1) % n for v in range(n)]
    return next((near for _ in range(tries) if (near := paired(n, list(range(n)), draw, ring))), None)


def stub_pairing(n: int, draw: random.Random, tries: int = 2000) -> list[int] | None:
    """Odd orders: stubs of one vertex of degree 4 and others of degree 3."""
    for _ in range(tries):
        near = paired(n, [v for v in range(n) for _ in range(3 if v else 4)], draw, [0] * n)
        if near and legal(near):
            return near
    return None


#: Name -> generator of one graph (neighbour masks) of an order; register more.
GENERATORS = {
    "cycle_matching_stub_pairing": lambda n, draw: stub_pairing(n, draw) if n % 2 else cycle_matching(n, draw),
    "random_regular": lambda n, draw: random_regular(n, 4 if n % 2 else draw.choice((3, 4)), draw),
    "erdos_renyi_rejection": lambda n, draw: random_mean(n, draw.uniform(5, 8), draw),
    "degree_sequence_rejection": lambda n, draw: random_degrees(n, 3, 6, draw),
}


def attempt_seed(seed: int, attempt: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{attempt}".encode()).digest()[:8], "big")


def _attempts(frames: Iterator[pd.DataFrame], seed: int, low: int, high: int) -> Iterator[pd.DataFrame]:
    names = sorted(GENERATORS)
    for frame in frames:
        rows = []
        for attempt in frame["id"].tolist():
            draw = random.Random(attempt_seed(seed, attempt))
            name, n = names[attempt % len(names)], draw.randint(low, high)
            near = GENERATORS[name](n, draw)
            good = near is not None and legal(near)
            rows.append((attempt, name, n, edges_of(near) if good else None))
        yield pd.DataFrame(rows, columns=["attempt", "generator", "n", "edges"])


def attempts(spark, count: int, seed: int, low: int, high: int) -> DataFrame:
    """(attempt, generator, n, edges): edges are null where rejected."""
    from functools import partial

    return spark.range(count).mapInPandas(partial(_attempts, seed=seed, low=low, high=high), "attempt long, generator string, n int, edges array<struct<u:int,v:int>>")


def distinct_graphs(spark, wanted: int, seed: int, low: int, high: int) -> DataFrame:
    """(attempt, generator, n, graph_hash): the first `wanted` distinct graphs.
    Attempts grow to 100 for each that is wanted (1000 at least); an error if
    they do not hold enough."""
    most = max(1000, 100 * wanted)
    count = min(most, 10 * wanted)
    while True:
        found = attempts(spark, count, seed, low, high).filter("edges IS NOT NULL").withColumn("graph_hash", graph_hash(F.col("edges"), F.col("n")))
        first = found.groupBy("graph_hash").agg(F.min_by(F.struct("attempt", "generator", "n"), "attempt").alias("g"))
        first = first.select("g.attempt", "g.generator", "g.n", "graph_hash").orderBy("attempt").limit(wanted)
        had = first.count()
        if had >= wanted:
            return first
        if count == most:
            raise ValueError(f"only {had} of {wanted} distinct graphs in {most} attempts")
        count = min(most, 3 * count)
