"""N-gram Jaccard join: near duplicates by exact similarity of shingle sets.

Texts with the same set are one node (a 64-bit hash of the set), so copies
never meet in pairs. Every node's shingles are put in one global order, rare
first: by the number of nodes that have them, then by hash. Two sets that are
similar enough share a shingle among the first n - ceil(t n) + 1 of each (the
prefix); shingles that no other node has cannot be shared, so most texts have
no prefix left to join on. Candidates share a prefix shingle and must pass

  length      n_small >= t n_large, as part of the join's key (a length band)
  position    what follows the shared shingle must suffice for the overlap
  suffix      sets fall into 64 hash ranges, whose counts bound the overlap, and
              the parities of 1024 hash classes bound the difference

and are verified once per pair on the whole sets. Nodes that hang together
need no more pairs: rounds of stars around a few members of each shingle's
list are verified first, and then all candidates from different components. So a group of k near copies costs about k
verifications instead of k squared, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import by_block, by_range, edges, fetch, hash_bits, merge, same_scan
from .common import components, delete, join_groups, written
from .dedup import without
from .words import Texts, Words, chunks, mix, pack, shingles, squeeze, stretch, unpack

WIDTH = 5
#: Least similarity in hundredths.
LEAST = 80
#: Texts' shingles of a block.
BLOCK = 800_000
#: Hash ranges of the suffix filter, and the orders in which stars are formed.
RANGES, STARS, ROUNDS = 64, 4, 3
#: 64-bit words of parities.
PARITY = 16


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash: (shingle, text,
    set size of each text, node of each text)."""
    words = Words(Texts(batch.column("text")))
    key, owner = shingles(words, width)
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    sizes = np.bincount(owner, minlength=batch.num_rows)
    node = np.zeros(batch.num_rows, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(node, owner, mix(key ^ np.uint64(0xA0761D6478BD642F)))
        node = mix(node + sizes.astype(np.uint64))
    return key, owner, sizes, node.view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, shingles, sizes, nodes) with each node once a block."""
    from pyspark import TaskContext

    task, number, seen = TaskContext.get().partitionId(), 0, set()
    keys, sizes, nodes, held = [], [], [], 0
    for batch in chunks(batches, limit=2 << 20):
        key, owner, size, node = _sets(batch, width)
        new = np.zeros(len(node), bool)
        new[np.unique(node, return_index=True)[1]] = True
        new &= size > 0
        new &= np.fromiter((x not in seen for x in node.tolist()), bool, len(node))
        seen.update(node[new].tolist())
        keys.append(key[new[owner]])
        sizes.append(size[new])
        nodes.append(node[new])
        held += len(keys[-1])
        if held > BLOCK:
            yield task << 20 | number, np.concatenate(keys), np.concatenate(sizes), np.concatenate(nodes)
            keys, sizes, nodes, held, number, seen = [], [], [], 0, number + 1, set()
    if held:
        yield task << 20 | number, np.concatenate(keys), np.concatenate(sizes), np.concatenate(nodes)


def _nodes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=2 << 20):
        _, _, sizes, node = _sets(batch, width)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(node)], ["doc_id", "n_shingles", "node"])


def _ask(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    for block, keys, _, _ in _blocks(batches, width):
        distinct, counts = np.unique(keys, return_counts=True)
        at = edges(distinct, bits)
        rows = [(p, block, pack(distinct[a:b]), squeeze(counts[a:b].astype(np.int32))) for p, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64(), pa.binary(), pa.binary()])], ["part", "block", "keys", "counts"])


def _answer(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    table, codes, first, cuts = merge(table)
    counts = np.concatenate([stretch(b, np.int32) for b in table.column("counts").to_pylist()])
    total = np.minimum(np.bincount(codes, counts, len(first)), 2**31 - 1).astype(np.int32)[codes]
    size = table.num_rows
    return pa.table([pa.array([1] * size, pa.int32()), pa.array([part] * size, pa.int32()), table.column("block"), pa.array([squeeze(x) for x in np.split(total, cuts)], pa.binary())], ["n", "part", "block", "answer"])


def _ranges(key: np.ndarray) -> bytes:
    return np.bincount((key >> np.uint64(58)).astype(np.int64), minlength=RANGES).astype("<u4").tobytes()


def _parities(key: np.ndarray) -> list[int]:
    """How many shingles fall into each of 64 * PARITY classes, odd or even.
    Classes that differ between two sets are no more than their difference."""
    odd = np.bincount((key & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


MEMBERS = "node long, n int, prefix array<struct<key: long, pos: int>>, keys binary, ranges binary, parity array<long>"


def _members(batches: Iterator[pa.RecordBatch], width: int, least: int, counts: str) -> Iterator[pa.RecordBatch]:
    """Nodes that have a prefix shingle that others have too."""
    for block, keys, sizes, nodes in _blocks(batches, width):
        answer = fetch(counts, block, 1, np.int32)
        distinct, codes = np.unique(keys, return_inverse=True)
        if len(answer) != len(distinct):
            raise RuntimeError("the texts came in another order than before; write them to a table first")
        often = answer[codes]
        del distinct, codes, answer
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        first = np.cumsum(sizes) - sizes
        order = np.lexsort((often, owner))  # stable, and a text's shingles come by hash
        rank = np.arange(len(keys)) - first[owner]  # owner is sorted, so it is the same before and after
        shared = (rank < (sizes - -(-least * sizes // 100) + 1)[owner]) & (often[order] > 1)
        rows: list[tuple] = []
        has = np.flatnonzero(np.bincount(owner[shared], minlength=len(sizes)))
        places, where = np.flatnonzero(shared), np.searchsorted(owner[shared], np.arange(len(sizes) + 1))
        for i in has.tolist():
            at = places[where[i] : where[i + 1]]
            own = keys[first[i] : first[i] + sizes[i]]
            prefix = [{"key": k, "pos": p} for k, p in zip(keys[order[at]].view(np.int64).tolist(), rank[at].tolist())]
            rows.append((int(nodes[i]), int(sizes[i]), prefix, pack(own), _ranges(own), _parities(own)))
            if len(rows) >= 2000:
                yield _member_batch(rows)
                rows = []
        if rows:
            yield _member_batch(rows)


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32())])), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["node", "n", "prefix", "keys", "ranges", "parity"])


def _suffix_filter(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose counts by hash range allow the overlap."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, RANGES) for c in ("ranges_a", "ranges_b"))
        common = np.minimum(a, b).sum(axis=1, dtype=np.int64)
        union = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy() - common
        yield batch.select(["a", "b"]).filter(pa.array(100 * common >= least * union))


def _verify(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, last, own = [], None, None
        for x, y in zip(batch.column("keys_a"), batch.column("keys_b")):
            if x != last:  # pairs of a hub come together
                last, own = x, unpack(x.as_py())
            other = unpack(y.as_py())
            both = np.concatenate([own, other])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            good.append(100 * common >= least * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _with_roots(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """lists with the component of each node so far (itself, if alone)."""
    if roots is None:
        return lists.withColumn("root", F.col("node"))
    return lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _similar(pairs: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """The pairs (a < b, each once) that are similar enough."""
    narrow = members.select("node", "n", "ranges")
    one = narrow.toDF("a", "n_a", "ranges_a")
    other = narrow.toDF("b", "n_b", "ranges_b")
    close = pairs.join(one, "a").join(other, "b").mapInArrow(partial(_suffix_filter, least=least), "a long, b long")
    close = written(close, "candidates")
    keys = members.select("node", "keys")
    full = close.join(keys.toDF("a", "keys_a"), "a").join(keys.toDF("b", "keys_b"), "b")
    return written(full.mapInArrow(partial(_verify, least=least), "a long, b long"), "links")


def links(df: DataFrame, width: int = WIDTH, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, component_id) for every row.

    component_id is the smallest doc_id that links reach from the row. A text
    with fewer than `width` words is one shingle; one without words (or null)
    is linked with nothing, and its component is itself. A null key never is
    the smallest; rows whose component has null keys only get null. Repeated
    keys are rows of their own. df is a table: its rows must come in the same
    order in every pass, which is checked.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with same_scan(spark):
        bits = hash_bits(docs)
        rows = written(docs.mapInArrow(partial(_nodes, width=width), "doc_id long, n_shingles long, node long"), "nodes")
        asked = docs.mapInArrow(partial(_ask, width=width, bits=bits), "part int, block long, keys binary, counts binary")
        counts = by_block(by_range(asked, bits).groupBy("part").applyInArrow(_answer, "n int, part int, block long, answer binary"), docs, "counts")
        found = written(docs.mapInArrow(partial(_members, width=width, least=least, counts=counts), MEMBERS), "members")
    # a node that several blocks have: its rows are alike, one is taken
    members = written(found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "keys", "ranges", "parity")]), "members")
    delete(spark, counts)

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / least)) + 1e-9).cast("int")
    lists = written(members.select("node", "n", F.explode("prefix").alias("p"), band.alias("band")).select("node", "n", "band", "p.key", "p.pos"), "lists")

    # stars: the centre of a list is its least member in one of a few orders
    roots, good = None, None
    for turn in range(ROUNDS):
        now = _with_roots(lists, roots)
        centre = F.min(F.struct(F.xxhash64("node", F.pmod("key", F.lit(STARS)), F.lit(turn)).alias("o"), F.col("node").alias("c"), F.col("n").alias("cn"), F.col("root").alias("croot")))
        centres = now.groupBy("key", "band").agg(centre.alias("s"), F.count("*").alias("k")).filter("k > 1").select("key", "band", "s.c", "s.cn", "s.croot")
        star = now.join(centres, ["key", "band"]).filter("root <> croot").filter(_long_enough("n", "cn", least))
        star = star.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
        new = _similar(star, members, least)
        good = new if good is None else good.union(new)
        roots = written(components(good), "roots")

    # the rest: candidates from different components
    joined = written(_with_roots(lists, roots), "lists")
    mixed = joined.groupBy("key").agg((F.min("root") < F.max("root")).alias("mixed")).filter("mixed").select("key")
    left = joined.join(mixed, "key", "left_semi").join(members.select("node", "parity"), "node")
    columns = ("node", "n", "pos", "root", "parity")
    one = left.select("key", F.col("band").alias("meet"), *[F.col(c).alias(f"{c}_a") for c in columns])
    # lengths within the ratio lie in the same band or the next
    other = left.select("key", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("meet"), *[F.col(c).alias(f"{c}_b") for c in columns])
    both = F.col("n_a") + F.col("n_b")
    need = F.ceil(both * least / F.lit(100 + least))
    room = F.least("pos_a", "pos_b") + 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    apart = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY)), F.lit(0))
    close = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _long_enough("n_a", "n_b", least) & (room >= need)
    # what the pair must share makes its own prefixes shorter
    close = close & (F.col("pos_a") <= F.col("n_a") - need) & (F.col("pos_b") <= F.col("n_b") - need)
    close = close & (one["key"] == other["key"]) & (one["meet"] == other["meet"]) & (apart <= both - 2 * need)
    pairs = one.join(other, close).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    more = _similar(pairs, members, least)
    roots = components(good.union(more))

    # components back to rows; hot nodes and components are joined apart
    real = rows.filter("n_shingles > 0")
    per = written(real.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    tops = per.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("k"))
    by_node = written(join_groups(per, written(tops, "tops"), "root", "k", per.count()).select("node", "component_id", "rows"), "classes")
    out = join_groups(real, by_node, "node", "rows", real.count()).select("doc_id", "n_shingles", "node", "component_id")
    return out.unionByName(rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")))


def _long_enough(one: str, other: str, least: int) -> Column:
    return F.least(one, other) * 100 >= F.greatest(one, other) * least


def keep_one(df: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """df without the rows that hang together with one of smaller doc_id; rows
    of one doc_id stay or go together. Rows with null ids stay."""
    found = links(df, width, least)
    return without(df, found.filter("doc_id <> component_id"), "doc_id").select(*df.columns)
