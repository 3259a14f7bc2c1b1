"""Cycles of a given length: by joins that extend paths, by pairs of half paths
in numpy over many graphs at once, and by a bit-mask search in Python batches
that knows caps and budgets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girthkit.sources.corpus import adjacency, nested


def paths_from_least(edges: DataFrame, length: int) -> DataFrame:
    """(gid, v1 .. vL): simple paths of `length` vertices whose first is the
    least, grown by one equi-join an edge."""
    adj = adjacency(edges).select("gid", "u", "v")
    paths = adj.filter("u < v").select("gid", F.col("u").alias("v1"), F.col("v").alias("v2"))
    for k in range(3, length + 1):
        step = adj.select("gid", F.col("u").alias(f"v{k - 1}"), F.col("v").alias(f"v{k}"))
        new = F.col(f"v{k}") > F.col("v1")
        for j in range(2, k - 1):
            new = new & (F.col(f"v{j}") != F.col(f"v{k}"))
        paths = paths.join(step, ["gid", f"v{k - 1}"]).filter(new)
    return paths


def cycles_by_joins(edges: DataFrame, length: int) -> DataFrame:
    """(gid, v1 .. vL): every cycle once, v1 least and v2 < vL. The last vertex
    is found by meeting two half paths, so no path of full length is kept that
    does not close."""
    half = length // 2 + 1
    ahead = paths_from_least(edges, half)
    back = ahead if length % 2 == 0 else paths_from_least(edges, half + 1)
    other = length - half + 2  # vertices of the half that runs the other way
    back = back.select("gid", "v1", F.col(f"v{other}").alias(f"v{half}"), *[F.col(f"v{k}").alias(f"w{k}") for k in range(2, other)])
    joined = ahead.join(back, ["gid", "v1", f"v{half}"])
    for i in range(2, half):
        for j in range(2, other):
            joined = joined.filter(F.col(f"v{i}") != F.col(f"w{j}"))
    names = ["v1", *[f"v{k}" for k in range(2, half + 1)], *[f"w{k}" for k in range(other - 1, 1, -1)]]
    out = joined.filter(F.col("v2") < F.col("w2")).select("gid", *names)
    return out.toDF("gid", *[f"v{k}" for k in range(1, length + 1)])


def neighbour_masks(n: int, edges) -> list[int]:
    out = [0] * n
    for e in edges:
        u, v = int(e["u"]), int(e["v"])
        out[u] |= 1 << v
        out[v] |= 1 << u
    return out


def search(near: list[int], length: int, cap: int | None = None, budget: int | None = None, keep: list | None = None) -> tuple[int, bool, int]:
    """(cycles, complete, vertices visited) of a graph. Each cycle is met at
    its least vertex and in one direction. Ends early at `cap` cycles or after
    `budget` visits; `keep` collects the vertices of each cycle."""
    count, visits = 0, 0
    for start, around in enumerate(near):
        visits += 1
        if budget is not None and visits > budget:
            return count, False, visits - 1
        higher = ~((2 << start) - 1)
        path, used = [start], 1 << start
        open_sets = [around & higher]
        while open_sets:
            left = open_sets[-1]
            if not left:
                open_sets.pop()
                used &= ~(1 << path.pop())
                continue
            bit = left & -left
            open_sets[-1] = left ^ bit
            vertex = bit.bit_length() - 1
            visits += 1
            if budget is not None and visits > budget:
                return count, False, visits - 1
            if len(path) + 1 == length:
                if around & bit and path[1] < vertex:
                    count += 1
                    if keep is not None:
                        keep.append([*path, vertex])
                    if cap is not None and count >= cap:
                        return count, False, visits
                continue
            path.append(vertex)
            used |= bit
            open_sets.append(near[vertex] & higher & ~used)
    return count, True, visits


def _count(frames: Iterator[pd.DataFrame], lengths: tuple[int, ...], cap: int | None, budget: int | None) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for gid, n, edges in frame[["gid", "n", "edges"]].itertuples(index=False):
            near = neighbour_masks(int(n), edges)
            rows += [(gid, length, *search(near, length, cap, budget)) for length in lengths if length <= n]
        yield pd.DataFrame(rows, columns=["gid", "length", "observed", "complete", "nodes"])


def count_cycles(edges: DataFrame, lengths: tuple[int, ...], cap: int | None = None, budget: int | None = None) -> DataFrame:
    """(gid, length, observed, complete, nodes) for lengths up to the order."""
    return nested(edges).mapInPandas(partial(_count, lengths=lengths, cap=cap, budget=budget), "gid long, length int, observed long, complete boolean, nodes long")


#: Paths, and pairs of paths, that are held at once.
AT_ONCE = 1 << 20
#: Lengths that are counted by pairs of half paths.
BY_PAIRS = (4, 6, 8)


class Graphs:
    """The graphs of a batch of nested rows as arrays: orders, and the two ends
    of all edges, those of graph i from first[i] on."""

    def __init__(self, batch: pa.RecordBatch):
        edges = batch.column("edges")
        flat = edges.flatten()
        self.order = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.u, self.v = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in "uv")
        if len(self.order) and self.order.max() > 64:
            raise ValueError("sets of vertices are bits of 64: no order above 64")

    def some(self, rows: np.ndarray) -> Graphs:
        out = object.__new__(Graphs)
        sizes = (self.first[1:] - self.first[:-1])[rows]
        ends = np.cumsum(sizes)
        at = np.arange(sizes.sum()) + np.repeat(self.first[:-1][rows] - (ends - sizes), sizes)
        out.order, out.first, out.u, out.v = self.order[rows], np.concatenate([[0], ends]), self.u[at], self.v[at]
        return out

    def links(self, loops: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vertices of all graphs are numbered through: (graph of each, its bit,
        neighbours of all by vertex, how many each has, where they begin).
        loops: a vertex is its own neighbour, too."""
        base = np.concatenate([[0], np.cumsum(self.order)])
        owner = np.repeat(np.arange(len(self.order)), self.order)
        graph = np.repeat(np.arange(len(self.order)), self.first[1:] - self.first[:-1])
        one, other, own = self.u + base[graph], self.v + base[graph], np.arange(base[-1] if loops else 0)
        source, target = np.concatenate([one, other, own]), np.concatenate([other, one, own])
        degree = np.bincount(source, minlength=base[-1])
        bit = np.uint64(1) << (np.arange(base[-1]) - base[owner]).astype(np.uint64)
        return owner, bit, target[np.argsort(source, kind="stable")], degree, np.cumsum(degree) - degree

    def near(self, row: int) -> list[int]:
        out = [0] * int(self.order[row])
        for u, v in zip(self.u[self.first[row] : self.first[row + 1]].tolist(), self.v[self.first[row] : self.first[row + 1]].tolist()):
            out[u] |= 1 << v
            out[v] |= 1 << u
        return out


def even_cycles(graphs: Graphs, length: int) -> np.ndarray:
    """Cycles of an even length in each graph. Two paths of half the length
    between the same two ends that share no inner vertex are a cycle, and each
    cycle has length / 2 pairs of opposite ends."""
    half = length // 2
    owner, bit, target, degree, begin = graphs.links()
    widest = np.zeros(len(graphs.order), np.int64)
    np.maximum.at(widest, owner, degree)
    share = np.cumsum(degree * np.maximum(widest[owner] - 1, 1) ** (half - 1)) // AT_ONCE
    found = np.zeros(len(graphs.order), np.int64)
    for start in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(share)) + 1):
        end, used = start, bit[start]
        for step in range(half):
            fan = degree[end]
            path = np.repeat(np.arange(len(end)), fan)
            after = target[np.arange(len(path)) - np.repeat(np.cumsum(fan) - fan, fan) + begin[end][path]]
            keep = (used[path] & bit[after]) == 0
            if step == half - 1:
                keep &= after > start[path]
            path, end = path[keep], after[keep]
            start, used = start[path], used[path] | bit[end]
        order = np.lexsort((end, start))
        start, end = start[order], end[order]
        inner = used[order] & ~(bit[start] | bit[end])
        head, place = _heads(start, end), np.arange(len(start))
        for part in np.split(place, np.flatnonzero(np.diff(np.cumsum(place - head) // AT_ONCE)) + 1):
            one, other = _earlier(head, part)
            apart = (inner[one] & inner[other]) == 0
            found += np.bincount(owner[start[one[apart]]], minlength=len(found))
    return found // half


def _earlier(head: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, an earlier row of its group) for each of `rows`; head: the first
    row of each row's group."""
    count = rows - head[rows]
    row = np.repeat(rows, count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + head[row]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """The first row of each row's group, for sorted keys."""
    place = np.arange(len(keys[0]))
    new = np.ones(len(place), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, place, 0)) if len(place) else place


def four_cycles(graphs: Graphs) -> np.ndarray:
    """(a, b, c, d) of every four-cycle a-b-c-d as vertices numbered through,
    a its least and b < d, sorted by graph and vertices."""
    _, _, target, degree, begin = graphs.links()
    a, c, b = np.arange(len(degree)), np.arange(len(degree)), np.arange(len(degree))
    for _ in range(2):
        path = np.repeat(np.arange(len(c)), degree[c])
        after = target[np.arange(len(path)) - np.repeat(np.cumsum(degree[c]) - degree[c], degree[c]) + begin[c][path]]
        keep = after > a[path]
        a, b, c = a[path[keep]], c[path[keep]], after[keep]
    order = np.lexsort((b, c, a))
    a, b, c = a[order], b[order], c[order]
    second, first = _earlier(_heads(a, c), np.arange(len(a)))
    found = np.stack([a[first], b[first], c[first], b[second]])
    return found[:, np.lexsort(found[::-1])]


def reach(graphs: Graphs) -> list[np.ndarray]:
    """Masks of the vertices within distance 0, 1, .. of each vertex, until
    nothing more is reached."""
    _, bit, target, degree, begin = graphs.links(loops=True)
    layers = [bit]
    while len(bit):
        more = np.bitwise_or.reduceat(layers[-1][target], begin)
        if (more == layers[-1]).all():
            break
        layers.append(more)
    return layers


def _cycle_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        graphs = Graphs(batch)
        owner, bit, *_ = graphs.links()
        cycles = four_cycles(graphs)
        graph, number = owner[cycles[0]], np.arange(cycles.shape[1])
        mask = np.bitwise_or.reduce(bit[cycles], axis=0)
        around = [np.bitwise_or.reduce(layer[cycles], axis=0) for layer in reach(graphs)]
        sides = np.stack([np.minimum(cycles[k], cycles[k - 1]) * len(owner) + np.maximum(cycles[k], cycles[k - 1]) for k in range(4)])
        head = _heads(graph)
        for part in np.split(number, np.flatnonzero(np.diff(np.cumsum(number - head) // AT_ONCE)) + 1):
            j, i = _earlier(head, part)
            far = np.full(len(i), -1, np.int32)
            for k, layer in enumerate(around):
                far[(far < 0) & ((layer[i] & mask[j]) != 0)] = k
            vertices = np.bitwise_count(mask[i] & mask[j]).astype(np.int32)
            edges = sum((sides[x][i] == sides[y][j]).astype(np.int32) for x in range(4) for y in range(4))
            columns = [batch.column("gid").take(pa.array(graph[i])), *[pa.array((x - head[x] + 1).astype(np.int32)) for x in (i, j)], pa.array(vertices), pa.array(edges), pa.array(far, mask=far < 0)]
            yield pa.RecordBatch.from_arrays(columns, ["gid", "i", "j", "shared_vertices", "shared_edges", "distance"])


def cycle_pairs(edges: DataFrame) -> DataFrame:
    """(gid, i, j, shared_vertices, shared_edges, distance) of all pairs of a
    graph's four-cycles, numbered in the order of their vertices. distance is
    the least of any two of their vertices, null if none reaches the other."""
    return nested(edges).mapInArrow(_cycle_pairs, "gid long, i int, j int, shared_vertices int, shared_edges int, distance int")


def _evens(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        graphs = Graphs(batch)
        sizes = np.diff(graphs.first)
        columns = [batch.column("gid"), batch.column("n"), pa.array(sizes), *[pa.array(even_cycles(graphs, x)) for x in lengths]]
        yield pa.RecordBatch.from_arrays(columns, ["gid", "n", "m", *[f"c{x}" for x in lengths]])


def count_evens(edges: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(gid, n, m, c4, ...): edges and exact counts of even lengths up to 8 of
    every graph, by one shuffle."""
    kept = "".join(f", c{x} long" for x in lengths)
    return nested(edges).mapInArrow(partial(_evens, lengths=lengths), f"gid long, n int, m long{kept}")


def _cascade(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], incumbent: int, strict: bool) -> Iterator[pa.RecordBatch]:
    limit = incumbent if strict else incumbent + 1  # a total that is pruned
    for batch in batches:
        graphs = Graphs(batch)
        total, stage = np.zeros(len(graphs.order), np.int64), np.zeros(len(graphs.order), np.int32)
        for length in lengths:
            left = np.flatnonzero((stage == 0) & (graphs.order >= length))
            if length in BY_PAIRS:
                total[left] += even_cycles(graphs.some(left), length)
            else:
                total[left] += [search(graphs.near(i), length, cap=limit - int(total[i]))[0] for i in left.tolist()]
            stage[left[total[left] >= limit]] = length
        pruned = stage > 0
        yield pa.RecordBatch.from_arrays([batch.column("gid"), pa.array(total, mask=pruned), pa.array(stage, mask=~pruned)], ["gid", "total", "pruned_at"])


def cascade(edges: DataFrame, lengths: tuple[int, ...], incumbent: int, strict: bool = False) -> DataFrame:
    """(gid, total, pruned_at): lengths are scored in turn, and a graph goes as
    soon as its total passes the incumbent (strict: reaches it)."""
    return nested(edges).mapInArrow(partial(_cascade, lengths=lengths, incumbent=incumbent, strict=strict), "gid long, total long, pruned_at int")


def _witnesses(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for gid, n, edges in frame[["gid", "n", "edges"]].itertuples(index=False):
            kept: list = []
            search(neighbour_masks(int(n), edges), length, keep=kept)
            rows += [(gid, i, c) for i, c in enumerate(sorted(kept), 1)]
        yield pd.DataFrame(rows, columns=["gid", "i", "vertices"])


def witnesses(edges: DataFrame, length: int) -> DataFrame:
    """(gid, i, vertices): every cycle of a length, canonical and numbered."""
    return nested(edges).mapInPandas(partial(_witnesses, length=length), "gid long, i long, vertices array<int>")


def hitting_set(sets: list[int], most: int = 20) -> int | None:
    """Size of the least set of items (bits) that meets all sets; None if there
    are more than `most` sets. Iterative deepening over the items of the first
    set that is not met."""
    if len(sets) > most:
        return None

    def meets(left: list[int], size: int) -> bool:
        if not left:
            return True
        if not size:
            return False
        first = min(left, key=lambda s: s.bit_count())
        while first:
            bit = first & -first
            first ^= bit
            if meets([s for s in left if not s & bit], size - 1):
                return True
        return False

    size = 0
    while not meets(sets, size):
        size += 1
    return size


def _least(sets: list[int]) -> list[int]:
    """The sets without repeats and without those that hold another."""
    out: list[int] = []
    for s in sorted(set(sets), key=int.bit_count):
        if not any(t & s == t for t in out):
            out.append(s)
    return out


def _by_item(sets: list[int]) -> dict[int, int]:
    """Which sets an item (bit) is in, as bits."""
    on: dict[int, int] = {}
    for i, s in enumerate(sets):
        while s:
            bit = s & -s
            s ^= bit
            on[bit] = on.get(bit, 0) | 1 << i
    return on


def _reduced(sets: list[int]) -> tuple[list[int], int, dict[int, int]]:
    """(sets, taken, items): while an item is in no more sets than another it
    goes, and an item that is alone in a set is taken."""
    taken = 0
    while True:
        sets = _least(sets)
        alone = 0
        for s in sets:
            if s.bit_count() == 1:
                alone |= s
        if alone:
            taken += alone.bit_count()
            sets = [s for s in sets if not s & alone]
            continue
        on = _by_item(sets)
        kept: list[int] = []
        drop = 0
        for bit in sorted(on, key=lambda x: (-on[x].bit_count(), x)):
            if any(on[bit] & ~on[k] == 0 for k in kept):
                drop |= bit
            else:
                kept.append(bit)
        if not drop:
            return sets, taken, on
        sets = [s & ~drop for s in sets]


def _at_least(sets: list[int], on: dict[int, int]) -> int:
    """A lower bound: disjoint sets, or each set's share of its widest item."""
    used = packed = 0
    share = 0.0
    wide = {bit: x.bit_count() for bit, x in on.items()}
    for s in sets:
        if not s & used:
            used |= s
            packed += 1
        most, left = 0, s
        while left:
            bit = left & -left
            left ^= bit
            most = max(most, wide[bit])
        share += 1 / most
    return max(packed, int(share + 1 - 1e-9))


def least_hitting_set(sets: list[int]) -> int:
    """Size of the least set of items (bits) that meets all sets, however many:
    branch and bound over reduced sets, taking the widest item or leaving it."""
    left, best = list(sets), 0  # greedy, the first upper bound
    while left:
        on = _by_item(left)
        bit = max(on, key=lambda x: (on[x].bit_count(), x))
        left = [s for s in left if not s & bit]
        best += 1

    def search_(sets: list[int], size: int) -> None:
        nonlocal best
        sets, taken, on = _reduced(sets)
        size += taken
        if not sets:
            best = min(best, size)
            return
        if size + _at_least(sets, on) >= best:
            return
        bit = max(on, key=lambda x: (on[x].bit_count(), x))
        search_([s for s in sets if not s & bit], size + 1)
        search_([s & ~bit for s in sets], size)

    search_(list(sets), 0)
    return best


def _hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for gid, cycles in frame[["gid", "cycles"]].itertuples(index=False):
            number: dict[tuple, int] = {}
            by_vertex, by_edge = [], []
            for c in cycles:
                c = [int(x) for x in c]
                ends = [tuple(sorted(p)) for p in zip(c, c[1:] + c[:1])]
                by_vertex.append(sum(1 << v for v in c))
                by_edge.append(sum(1 << number.setdefault(e, len(number)) for e in ends))
            rows.append((gid, len(cycles), least_hitting_set(by_edge), least_hitting_set(by_vertex)))
        yield pd.DataFrame(rows, columns=["gid", "cycles", "tau_edge", "tau_vertex"]).astype({"tau_edge": "Int32", "tau_vertex": "Int32"})


def hitting_numbers(cycles: DataFrame) -> DataFrame:
    """(gid, cycles, tau_edge, tau_vertex) from witnesses."""
    grouped = cycles.groupBy("gid").agg(F.array_sort(F.collect_list("vertices")).alias("cycles"))
    return grouped.mapInPandas(_hits, "gid long, cycles long, tau_edge int, tau_vertex int")
