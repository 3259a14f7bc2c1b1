"""Cycles of many small graphs at once in numpy, by meeting half paths that
begin at the least vertex of a cycle. Sets of vertices are bits, paths are
sorted numbers, so nothing of a path is shuffled or kept beyond its batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Walks from the starts that are taken at once; paths are fewer.
WALKS = 1 << 21
#: Bits of a vertex in a path's number: orders up to 64.
STEP = 6


class Masks:
    """The graphs of a batch of rows, with edges as array (`nested`) or as bits
    (`graph_bits`): order, and near[graph, vertex], its neighbours as bits."""

    def __init__(self, batch: pa.RecordBatch, spare: int = 0):
        self.order = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        most = int(self.order.max(initial=1)) + spare
        if most > 64:
            raise ValueError("sets of vertices are bits of 64: no order above 64")
        if "edges" in batch.schema.names:
            edges = batch.column("edges")
            u, v = (edges.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in "uv")
            graph = np.repeat(np.arange(len(edges)), edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        else:
            words = [batch.column(x).to_numpy(zero_copy_only=False).astype("<i8") for x in batch.schema.names if x.startswith("w")]
            graph, bit = np.nonzero(np.unpackbits(np.stack(words, axis=1).view(np.uint8), axis=1, bitorder="little"))
            v, u = (x[bit] for x in np.tril_indices(65, -1))
        self.wide = 32 if most <= 32 else 64
        joined = np.zeros((len(self.order), self.wide, self.wide), bool)
        joined[graph, u, v] = joined[graph, v, u] = True
        self.near = np.packbits(joined, axis=2, bitorder="little").view(f"<u{self.wide // 8}")[:, :, 0]

    def some(self, rows: np.ndarray) -> Masks:
        out = object.__new__(Masks)
        out.order, out.wide, out.near = self.order[rows], self.wide, self.near[rows]
        return out

    def inside(self) -> np.ndarray:
        """Which of near's places are vertices."""
        return np.arange(self.wide) < self.order[:, None]

    def joined(self) -> np.ndarray:
        """near as booleans [graph, vertex, vertex]."""
        return np.unpackbits(np.ascontiguousarray(self.near)[:, :, None].view(np.uint8), axis=2, bitorder="little").astype(bool)

    def admissible(self, least: int = 3) -> np.ndarray:
        """Graphs that are connected and of a minimum degree."""
        rows = np.flatnonzero(np.where(self.inside(), np.bitwise_count(self.near), 64).min(axis=1) >= least)
        near, place = self.near[rows], np.arange(self.wide, dtype=self.near.dtype)
        seen = np.ones(len(rows), self.near.dtype)
        while True:
            on = (seen[:, None] >> place & 1).astype(bool)
            more = seen | np.bitwise_or.reduce(np.where(on, near, 0), axis=1, dtype=self.near.dtype)
            if (more == seen).all():
                return rows[np.bitwise_count(seen) == self.order[rows]]
            seen = more


def _longer(near: np.ndarray, wide: int, graph: np.ndarray, end: np.ndarray, used: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paths by one vertex more that is not used, in no order."""
    one = near.dtype.type(1)
    left = near[graph.astype(np.int64) * wide + end] & ~used
    at = np.flatnonzero(left)
    left, found = left[at], [(at[:0], left[:0])]
    while len(at):
        low = left & (~left + one)
        found.append((at, low))
        left ^= low
        more = np.flatnonzero(left)
        at, left = at[more], left[more]
    at, low = (np.concatenate(x) for x in zip(*found))
    vertex = np.bitwise_count(low - one).astype(np.uint32)
    return graph[at], vertex, used[at] | low, path[at] << np.uint32(STEP) | vertex


def half_paths(graphs: Masks, steps: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """By parts of the starts, for 2 to `steps` edges: (ends, inner, path,
    graph), sorted. ends tells graph, start and end; the start is less than all
    the others; inner has the vertices between as bits, path as digits."""
    near = np.ascontiguousarray(graphs.near).ravel()
    kind = near.dtype.type
    graph, start = (x.astype(np.uint32) for x in np.nonzero(graphs.inside()))
    joined, walks = graphs.joined(), np.ones(graphs.near.shape)
    for _ in range(steps):
        walks = (joined @ walks[:, :, None])[:, :, 0]
    share = np.cumsum(walks[graph, start]) // WALKS
    for rows in np.split(np.arange(len(graph)), np.flatnonzero(np.diff(share)) + 1):
        path = start[rows]
        state = graph[rows], path, (kind(2) << path.astype(kind)) - kind(1), path
        out = {}
        for step in range(1, steps + 1):
            state = _longer(near, graphs.wide, *state)
            if step > 1:
                digits = np.uint32(STEP * (step - 1))
                ends = state[3] >> (digits + np.uint32(STEP)) << np.uint32(STEP) | state[3] & np.uint32(63)
                whole = (state[0].astype(np.uint64) << np.uint64(2 * STEP) | ends) << np.uint64(digits) | state[3] >> np.uint32(STEP) & np.uint32((1 << digits) - 1)
                whole.sort()
                path = whole.astype(np.uint32) & np.uint32((1 << digits) - 1)
                inner = np.zeros(len(whole), near.dtype)
                for k in range(step - 1):
                    inner |= kind(1) << (path >> np.uint32(STEP * k) & np.uint32(63)).astype(kind)
                ends = whole >> np.uint64(digits)
                out[step] = ends, inner, path, (ends >> np.uint64(2 * STEP)).astype(np.int64)
        yield out


def _apart(inner: np.ndarray, first: np.ndarray, end: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each row, how many of the `others` from first to end share no vertex
    with it. Rows with most others come first, so each round is a prefix."""
    number = end - first
    order = np.argsort(-number, kind="stable")
    at, mine, found = first[order], inner[order], np.zeros(len(order), np.int64)
    sizes = np.bincount(number, minlength=1)
    for some in (len(order) - np.cumsum(sizes))[:-1].tolist():
        found[:some] += (mine[:some] & others[at[:some]]) == 0
        at[:some] += 1
    out = np.empty_like(found)
    out[order] = found
    return out


def _groups(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each row's group of equal ends."""
    new = np.flatnonzero(ends[1:] != ends[:-1]) + 1
    first, end = np.append(0, new), np.append(new, len(ends))
    return np.repeat(first, end - first), np.repeat(end, end - first)


def spectrum(graphs: Masks, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Exact counts of cycles of lengths 4 to 8 in each graph. An even cycle is
    a pair of half paths; an odd one is met in both directions."""
    if not set(lengths) <= set(range(4, 9)):
        raise ValueError("half paths count lengths 4 to 8")
    found = {x: np.zeros(len(graphs.order), np.int64) for x in lengths}
    for half in half_paths(graphs, (max(lengths) + 1) // 2):
        for length in lengths:
            ends, inner, _, graph = half[length // 2]
            if length % 2:
                ends_, others, *_ = half[length // 2 + 1]
                first, end = np.searchsorted(ends_, ends, "left"), np.searchsorted(ends_, ends, "right")
            else:
                others, first, end = inner, np.arange(1, len(ends) + 1), _groups(ends)[1]
            # sums of a part stay far below 2^53, where floats are exact
            found[length] += np.bincount(graph, _apart(inner, first, end, others), len(graphs.order)).astype(np.int64)
    return {x: k // (1 + x % 2) for x, k in found.items()}


def loads(graphs: Masks, length: int) -> np.ndarray:
    """[graph, u, v]: how many cycles of an even length up to 8 an edge is on."""
    half, wide = length // 2, graphs.wide
    found = np.zeros(len(graphs.order) * wide * wide, np.int64)
    for part in half_paths(graphs, half):
        ends, inner, path, graph = part[half]
        times = _apart(inner, *_groups(ends), inner)  # itself is never apart
        rows = np.flatnonzero(times)
        times, ends, path, graph = times[rows], ends[rows], path[rows], graph[rows]
        on = [(ends >> np.uint64(STEP)) & np.uint64(63), *[path >> np.uint32(STEP * k) & np.uint32(63) for k in range(half - 2, -1, -1)], ends & np.uint64(63)]
        on = [x.astype(np.int64) for x in on]
        for a, b in zip(on, on[1:]):
            np.add.at(found, (graph * wide + np.minimum(a, b)) * wide + np.maximum(a, b), times)
    return found.reshape(-1, wide, wide)


def _spectrum(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = spectrum(Masks(batch), lengths)
        columns = [pa.chunked_array([batch.column("gid")] * len(lengths), pa.int64()).combine_chunks(), pa.array(np.repeat(np.array(lengths, np.int32), batch.num_rows)), pa.array(np.concatenate([found[x] for x in lengths]))]
        yield pa.RecordBatch.from_arrays(columns, ["gid", "length", "observed"])


def count_lengths(graphs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(gid, length, observed): exact counts, 0 too, of rows of graphs (nested
    or as bits). No shuffle."""
    return graphs.mapInArrow(partial(_spectrum, lengths=lengths), "gid long, length int, observed long")
