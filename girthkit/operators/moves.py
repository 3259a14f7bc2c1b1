"""Families of candidates made in numpy within the rows of their graphs, for
queries that return marks, ranked moves or figures of the moved graphs: the
moves themselves, many times the edges, are made but neither shuffled nor kept."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from girthkit.operators.halves import Masks, loads

Edges = list[tuple[np.ndarray, np.ndarray]]
#: Moves, at most, of the graphs that are taken at once (more for a single graph).
MOVES = 1 << 18
#: Places of vertices in the order of their texts in JSON, where a comma follows
#: the first end of an edge and a brace the second.
TEXT_U, TEXT_V = (np.argsort(sorted(range(64), key=lambda x, after=after: f"{x}{after}")).astype(np.uint64) for after in ",}")


class Moves(NamedTuple):
    """Candidates by graph; the edges of each as in the arrays of a row."""

    graph: np.ndarray
    removed: Edges
    added: Edges


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for `count` places of each row, from its first on."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) + np.repeat(first - (np.cumsum(count) - count), count)


def _edge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(a, b), np.maximum(a, b)


def _in_order(one: tuple, other: tuple) -> Edges:
    swap = one[0] * 64 + one[1] > other[0] * 64 + other[1]
    pick = [(np.where(swap, y, x), np.where(swap, x, y)) for x, y in zip(one, other)]
    return [(pick[0][k], pick[1][k]) for k in (0, 1)]


def relocations(graphs: Masks, load: np.ndarray | None = None) -> Moves:
    """a-b -> a-t for a donor b of degree 4 or more and a non-neighbour t; of
    loaded edges only if there is a load."""
    joined, inside = graphs.joined(), graphs.inside()
    gone = joined & (np.bitwise_count(graphs.near) >= 4)[:, None, :]
    if load is not None:
        gone &= (load + load.transpose(0, 2, 1)) > 0
    new = ~joined & inside[:, :, None] & inside[:, None, :] & ~np.eye(graphs.wide, dtype=bool)
    count = new.sum(axis=2).ravel()
    graph, a, b = (x.astype(np.int32) for x in np.nonzero(gone))
    t, at = np.nonzero(new)[2].astype(np.int32), graph * graphs.wide + a
    row, place = _spread((np.cumsum(count) - count)[at], count[at])
    graph, a, b, t = graph[row], a[row], b[row], t[place]
    return Moves(graph, [_edge(a, b)], [_edge(a, t)])


def switches(graphs: Masks, load: np.ndarray | None = None) -> Moves:
    """a-b, c-d -> a-c, b-d or a-d, b-c, where the new edges are new; only with
    a loaded edge among the old ones if there is a load."""
    joined = graphs.joined()
    graph, u, v = (x.astype(np.int32) for x in np.nonzero(np.triu(joined)))
    first = np.searchsorted(graph, graph)
    late, early = _spread(first, np.arange(len(graph)) - first)
    if load is not None:
        heavy = load[graph, u, v] > 0
        some = heavy[late] | heavy[early]
        late, early = late[some], early[some]
    a, b, c, d = u[early], v[early], u[late], v[late]
    rows = np.flatnonzero((a != c) & (a != d) & (b != c) & (b != d))
    graph, a, b, c, d = graph[late][rows], a[rows], b[rows], c[rows], d[rows]
    made = []
    for x, y in ((c, d), (d, c)):
        free = np.flatnonzero(~joined[graph, a, x] & ~joined[graph, b, y])
        made.append([k[free] for k in (graph, a, b, c, d, x, y)])
    graph, a, b, c, d, x, y = (np.concatenate(k) for k in zip(*made))
    order = np.argsort(graph, kind="stable")
    graph, a, b, c, d, x, y = (k[order] for k in (graph, a, b, c, d, x, y))
    return Moves(graph, [(a, b), (c, d)], _in_order(_edge(a, x), _edge(b, y)))


def split_spokes(graphs: Masks) -> Moves:
    """A vertex more, put on an edge and joined to a third vertex."""
    graph, u, v = (x.astype(np.int32) for x in np.nonzero(np.triu(graphs.joined())))
    row, w = _spread(np.zeros(len(graph), np.int64), graphs.order[graph])
    rows = np.flatnonzero((w != u[row]) & (w != v[row]))
    row, w = row[rows], w[rows].astype(np.int32)
    graph, u, v = graph[row], u[row], v[row]
    new = graphs.order[graph].astype(np.int32)
    return Moves(graph, [(u, v)], [(u, new), (v, new), (w, new)])


def marks(moves: Moves, graphs: int) -> tuple[np.ndarray, np.ndarray]:
    """(moves, mark) of each graph; the mark is a sum that pins every move."""
    term = np.zeros(len(moves.graph), np.int64)
    for edges, times, more in ((moves.removed, 1, 1), (moves.added, 3, 7)):
        for u, v in edges:
            code = u * 64 + v
            term += times * code * (code + more)
    count = np.bincount(moves.graph, minlength=graphs)
    total, end = np.append(0, np.cumsum(term)), np.cumsum(count)
    return count, total[end] - total[end - count]


def heaviest(moves: Moves, load: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, coverage, place): the moves of each graph whose removed edges are
    on most cycles (the sum of their loads, at least one), `keep` a graph; ties
    go by the text of the move in JSON."""
    cover = sum(load[moves.graph, u, v] for u, v in moves.removed)
    rows = np.flatnonzero(cover > 0)
    graph, cover = moves.graph[rows].astype(np.int64), cover[rows]
    # what is below a graph's last place goes before texts are compared
    most = int(cover.max(initial=0))
    sorted_ = np.sort(graph * (most + 1) + most - cover)
    count = np.bincount(graph, minlength=1)
    last = np.cumsum(count) - count + np.minimum(count, keep) - 1
    least = most - sorted_[last[graph]] % (most + 1)
    some = np.flatnonzero(cover >= least)
    rows, graph, cover = rows[some], graph[some], cover[some]
    text = np.zeros(len(rows), np.uint64)
    for u, v in [*moves.removed, *moves.added]:
        text = (text << np.uint64(6) | TEXT_U[u[rows]]) << np.uint64(6) | TEXT_V[v[rows]]
    order = np.lexsort((text, -cover, graph))
    rows, graph, cover = rows[order], graph[order], cover[order]
    place = np.arange(len(rows)) - np.searchsorted(graph, graph) + 1
    some = place <= keep
    return rows[some], cover[some], place[some]


def moved(graphs: Masks, moves: Moves, grown: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, least degree) of each moved graph: every move is applied to a
    copy of its graph's masks."""
    child, at, one = graphs.near[moves.graph], np.arange(len(moves.graph)), graphs.near.dtype.type(1)
    for edges, new in ((moves.removed, False), (moves.added, True)):
        for u, v in edges:
            for x, y in ((u, v), (v, u)):
                bit = one << y.astype(child.dtype)
                child[at, x] = child[at, x] | bit if new else child[at, x] & ~bit
    degree = np.bitwise_count(child)
    within = np.arange(graphs.wide) < (graphs.order[moves.graph] + grown)[:, None]
    return degree.sum(axis=1, dtype=np.int64) // 2, np.where(within, degree, 255).min(axis=1)


def _parts(graphs: Masks, moves: np.ndarray) -> Iterator[tuple[np.ndarray, Masks]]:
    """Graphs in parts of about MOVES moves; moves: a bound for each graph."""
    for rows in np.split(np.arange(len(moves)), np.flatnonzero(np.diff(np.cumsum(moves) // MOVES)) + 1):
        if len(rows):
            yield rows, graphs.some(rows)


def _sides(graphs: Masks) -> np.ndarray:
    return np.bitwise_count(graphs.near).sum(axis=1, dtype=np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        graphs = Masks(batch)
        for rows, part in _parts(graphs, _sides(graphs) * graphs.order):
            count, mark = marks(relocations(part), len(rows))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([batch.column("gid").take(pa.array(rows[some])), pa.array(count[some]), pa.array(mark[some])], ["gid", "moves", "mark"])


def relocation_marks(graphs: DataFrame) -> DataFrame:
    """(gid, moves, mark) of all relocations of rows of graphs. No shuffle."""
    return graphs.mapInArrow(_marks, "gid long, moves long, mark long")


def _pairs(edges: Edges, rows: np.ndarray) -> pa.Array:
    ends = [np.stack([e[k][rows] for e in edges], axis=1).ravel().astype(np.int32) for k in (0, 1)]
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(edges), pa.StructArray.from_arrays(ends, ["u", "v"]))


def _guided(batches: Iterator[pa.RecordBatch], family: str, length: int, keep: int) -> Iterator[pa.RecordBatch]:
    make = {"two_switch": switches, "c8_relocate": relocations}[family]
    for batch in batches:
        graphs = Masks(batch)
        good = graphs.admissible()
        graphs = graphs.some(good)
        bound = _sides(graphs) ** 2 // 4 if make is switches else _sides(graphs) * graphs.order
        for part_rows, part in _parts(graphs, bound):
            load = loads(part, length)
            moves = make(part, load)
            rows, cover, place = heaviest(moves, load, keep)
            at = pa.array(good[part_rows][moves.graph[rows]])
            columns = [batch.column("gid").take(at), batch.column("n").take(at), pa.array([family]).take(pa.array(np.zeros(len(rows), np.int64))), _pairs(moves.removed, rows), _pairs(moves.added, rows), pa.array(cover), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["gid", "n", "family", "removed", "added", "coverage", "place"])


def guided(graphs: DataFrame, family: str, length: int, keep: int) -> DataFrame:
    """(gid, n, family, removed, added, coverage, place) of the admissible of
    rows of graphs: moves that take away most cycles of a length, `keep` a
    graph; family is two_switch or c8_relocate. No shuffle."""
    return graphs.mapInArrow(partial(_guided, family=family, length=length, keep=keep), "gid long, n int, family string, removed array<struct<u:int,v:int>>, added array<struct<u:int,v:int>>, coverage long, place int")


def _spoked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        graphs = Masks(batch, spare=1)
        good = graphs.admissible()
        graphs = graphs.some(good)
        for rows, part in _parts(graphs, _sides(graphs) // 2 * graphs.order):
            moves = split_spokes(part)
            edges, least = moved(part, moves, 1)
            children, total, legal = (np.bincount(moves.graph, x, len(rows)).astype(np.int64) for x in (None, edges, least >= 3))
            some = np.flatnonzero(children)
            yield pa.RecordBatch.from_arrays([batch.column("gid").take(pa.array(good[rows][some])), *[pa.array(x[some]) for x in (children, total, legal)]], ["gid", "children", "edges", "legal"])


def spoked(graphs: DataFrame) -> DataFrame:
    """(gid, children, edges, legal) of the admissible of rows of graphs: how
    many graphs every split spoke makes, their edges, and how many of them have
    minimum degree 3. No shuffle."""
    return graphs.mapInArrow(_spoked, "gid long, children long, edges long, legal long")
