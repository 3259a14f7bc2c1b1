"""Scalar functions on columns and their plain Python twins."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a cycle length is max(1, 64 div length).
WEIGHT_TOP = 64


def edge(a: Column | str, b: Column | str) -> Column:
    """An undirected edge as struct(u, v) with u <= v."""
    return F.struct(F.least(a, b).cast("int").alias("u"), F.greatest(a, b).cast("int").alias("v"))


def graph_hash(edges: Column, order: Column) -> Column:
    """SHA-256 of the canonical JSON of a graph (sorted edges, a line end last)."""
    pairs = F.transform(F.array_sort(edges), lambda e: F.concat(F.lit("["), e["u"].cast("string"), F.lit(","), e["v"].cast("string"), F.lit("]")))
    text = F.concat(F.lit('{"edges":['), F.array_join(pairs, ","), F.lit('],"order":'), order.cast("string"), F.lit("}\n"))
    return F.sha2(text.cast("binary"), 256)


def forbidden_lengths(order: Column) -> Column:
    """4, 8, 16, ... up to the order, 128 at most."""
    powers = F.array(*[F.lit(1 << k) for k in range(2, 8)])
    return F.filter(powers, lambda x: x <= order)


def cycle_weight(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(WEIGHT_TOP) / length)).cast("long")


def edge_excess(edges: Column, order: Column) -> Column:
    """Edges beyond the fewest that minimum degree 3 allows."""
    return edges - F.floor((order * 3 + 1) / 2).cast("long")


def status(observed: Column, complete: Column, cap: int) -> Column:
    """EXACT, SATURATED_AT_CAP or SEARCH_BUDGET_EXHAUSTED of a bounded count."""
    return F.when(observed >= cap, "SATURATED_AT_CAP").when(complete, "EXACT").otherwise("SEARCH_BUDGET_EXHAUSTED")


def count_bounds(observed: Column, state: Column, cap: int) -> tuple[Column, Column]:
    """Bounds of a count on the scale that ends at cap."""
    lower = F.least(observed, F.lit(cap))
    return lower, F.when(state == "SEARCH_BUDGET_EXHAUSTED", F.lit(cap)).otherwise(lower)


def energy_columns(order: Column, total: Column, weighted: Column, edges: Column, lengths: int, weight_sum: int, cap: int) -> tuple[Column, Column]:
    """(energy, greatest energy) as longs, for orders that share their lengths:
    one integer that orders graphs of an order by total, weighted total and
    edges; 1 - energy / greatest energy is the utility."""
    low = F.floor((order * 3 + 1) / 2).cast("long")
    span = (order * (order - 1) / 2).cast("long") - low
    top = F.lit(cap * weight_sum + 1).cast("long")
    energy = (total * top + weighted) * (span + 1) + edges - low
    most = (F.lit(cap * lengths).cast("long") * top + cap * weight_sum) * (span + 1) + span
    return energy.cast("long"), most.cast("long")
