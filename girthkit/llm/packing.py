"""Best-fit packing by bin completion.

Documents become token pieces of at most CAPACITY tokens. Packing depends on
the lengths alone, so it is solved on the histogram of lengths (at most
CAPACITY rows, whatever the input): branch and bound fills a sequence around
the largest piece left, tries the undominated fillings, fullest first, uses a
filling as often as the counts allow, then less often, and prunes by the waste that the best
solution so far would not have. Best-fit decreasing gives the first incumbent;
a solution as good as the lower bound ends the search. Pieces
are then numbered within their length, in salted buckets, and find their place
by their number.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .words import LOWER, Cache, Texts, Words, chunks, hashes

CAPACITY = 2048
#: Nodes that the search opens at most before it keeps its incumbent, and
#: partial fillings that it looks at in all.
NODES, STEPS = 6000, 1_000_000
#: Partial fillings that a node looks at before it first goes deeper, and
#: fillings that another is held against.
SOON, NEAREST = 1500, 40

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Plan = list[tuple[int, tuple[int, ...]]]


class WordIds:
    """Ids of words, each as 32-bit little-endian bytes. Words between white
    space can be encoded alone, or many as one text: the tokenizer cuts at
    white space. Words of letters give one token each that ends a word, which
    tells where their ids end. Between others stands SEPARATOR, a word of one
    id that words without it do not give. Where the number of ends is another,
    words are encoded alone."""

    SEPARATOR, END = b"\x01", "</w>"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        known = self.tokenizer.get_vocab()
        self.last, self.separator = np.zeros((2, max(known.values()) + 1), bool)
        ends = {token: i for token, i in known.items() if token.endswith(self.END)}
        if sum(len(token) == 1 + len(self.END) for token in ends) >= 256:  # any byte can end a word
            self.last[list(ends.values())] = True
        self.separator[self.encode([self.SEPARATOR])[0]] = True

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in made]

    def __call__(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(words), 4096):  # the library's results are large
            out += self.some(words[a : a + 4096])
        return out

    def some(self, words: list[bytes]) -> list[bytes]:
        letters = [w.decode().isalpha() for w in words]
        simple = iter(self.parts([*compress(words, letters)], b" ", self.last))
        other = iter(self.parts([w for w, x in zip(words, letters) if not x], b" %b " % self.SEPARATOR, self.separator))
        return [next(simple if x else other) for x in letters]

    def parts(self, words: list[bytes], between: bytes, ends: np.ndarray) -> list[bytes]:
        if not words:
            return []
        mark = ends is self.separator
        (ids,) = self.encode([between.join([*words, b""] if mark else words)])
        at = np.flatnonzero(ends[ids]) + 1
        if len(at) != len(words) or at[-1] != len(ids):
            return [x.tobytes() for x in self.encode(words)]
        flat, stops = ids.tobytes(), (4 * at).tolist()
        return [flat[a : b - 4 * mark] for a, b in zip([0, *stops], stops)]


@lru_cache(1)
def _cache(path: str) -> Cache:
    """One a Python worker: it outlives the tasks."""
    return Cache(WordIds(path))


def without_stops(words: Words) -> Words:
    """words with a full stop or comma after an ASCII letter as a word of its
    own, and A-Z lowered. The tokenizer cuts there and lowers anyway, and so
    there are fewer distinct words."""
    data, start, end = words.texts.data, words.start, words.end
    last, before = data[end - 1], data[np.maximum(end - 2, 0)] | 0x20
    cut = np.flatnonzero((end - start > 1) & ((last == 0x2E) | (last == 0x2C)) & (before >= 97) & (before <= 122))
    out = object.__new__(Words)
    out.texts = object.__new__(Texts)
    out.texts.data, out.texts.offsets = LOWER[data], words.texts.offsets
    ends = end.copy()
    ends[cut] -= 1
    out.start, out.end = np.insert(start, cut + 1, ends[cut]), np.insert(ends, cut + 1, end[cut])
    out.first = words.first + np.searchsorted(cut, words.first)
    out.hash = hashes(out.texts.data, out.start, out.end)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    cache = _cache(path)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in chunks(batches):
        words = without_stops(Words(Texts(batch.column("text")), hashed=False))
        values, codes = cache(words)
        own, listed, first, rows = values.tolist(), codes.tolist(), words.first.tolist(), []
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), first, first[1:]):
            ids = b"".join(map(own.__getitem__, listed[a:b])) + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc, k, k * capacity, len(part) // 4, zlib.crc32(part)))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of every row: its ids, then id 0, cut where longer than
    capacity. A null or empty text is one piece of the closing id."""
    small_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_pieces, path=path, capacity=capacity), PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts of lengths: bins of equal content go together."""
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_bins if r >= length):
            groups = open_bins.pop(room)
            while groups and left:
                number, items = groups.pop()
                each = min(room // length, left)
                used = min(number, left // each)
                open_bins.setdefault(room - each * length, []).append((used, items + (length,) * each))
                left -= used * each
                if used < number:
                    groups.append((number - used, items))
            if groups:
                open_bins.setdefault(room, []).extend(groups)
            if not left:
                break
        if left:
            each = capacity // length
            if left >= each:
                open_bins.setdefault(capacity - each * length, []).append((left // each, (length,) * each))
            if left % each:
                open_bins.setdefault(capacity - left % each * length, []).append((1, (length,) * (left % each)))
    return [group for groups in open_bins.values() for group in groups]


def _dominated(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """The items of `one` fit into bins of the sizes in `other`."""
    if not one:
        return True
    if sum(one) > sum(other):
        return False
    item, rest = one[0], one[1:]
    for k in range(len(other)):
        if other[k] >= item and _dominated(rest, tuple(sorted(other[:k] + (other[k] - item,) + other[k + 1 :], reverse=True))):
            return True
    return False


def fillings(room: int, lengths: list[int], counts: dict[int, int], steps: list[int], one: bool = False) -> list[tuple[int, ...]]:
    """The undominated fillings of a room, fullest first. lengths: in
    descending order. Looks at steps[0] partial fillings at most, those with
    the longest pieces first, and takes them off; once they are used up the
    greedy filling stands for what was not seen. one: ends with the first
    filling that leaves no room. A filling is held against the NEAREST fullest
    others, which may keep a dominated one; that costs work only."""
    found: set[tuple[int, ...]] = set()

    def extend(at: int, left: int, items: tuple[int, ...]) -> bool:
        at = bisect_left(lengths, -left, at, key=lambda x: -x)  # the first length that fits
        if at == len(lengths):
            found.add(items)
            return one and left == 0
        for k in range(at, len(lengths)):
            length = lengths[k]
            for times in range(min(counts[length], left // length), 0, -1):
                steps[0] -= 1
                if steps[0] < 0 or extend(k + 1, left - times * length, items + (length,) * times):
                    return True
        return False

    if room and lengths:
        extend(0, room, ())
    if steps[0] < 0:
        left, items = room, ()
        for length in lengths:
            times = min(counts[length], left // length)
            items, left = items + (length,) * times, left - times * length
        found.add(items)
    order = sorted(found)  # by sum, number and items, with no long keys at once
    found.clear()
    order.sort(key=len)
    order.sort(key=sum, reverse=True)
    kept: list[tuple[int, ...]] = []
    for items in order:
        if not any(len(items) <= 8 and len(k) <= 8 and _dominated(items, k) for k in kept[:NEAREST]):
            kept.append(items)
    return kept or [()]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by the total length, and for each threshold k by the
    pieces over half the capacity, which lie alone, with what the pieces of k
    up to half need beyond the room that is left beside them."""
    number = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        number[length] = count
    size = number * np.arange(capacity + 1)
    half, best = capacity // 2, -(-int(size.sum()) // capacity)
    many, much = np.cumsum(number), np.cumsum(size)
    for k in range(half + 1):
        alone = many[capacity] - many[half]
        beside = (many[capacity - k] - many[half]) * capacity - (much[capacity - k] - much[half])
        small = much[half] - (much[k - 1] if k else 0)
        best = max(best, int(alone + max(0, -(-(small - beside) // capacity))))
    return best


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, steps: int = STEPS) -> Plan:
    """(number of sequences, their lengths) for all pieces: bin completion.
    Opens `nodes` nodes at most and looks at `steps` partial fillings in all;
    beyond that the incumbent stays. A node tries a full filling that is found
    soon, as often as the counts allow, then less often, and when the search
    comes back to it all its other fillings in the same way."""
    counts = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    bound = least_sequences(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for n, _ in best)
    # A stack of generators: a filling's uses can be many levels deep. All share
    # what is left at the node on top, so a level keeps no histogram of its own.
    opened, left_steps, left, plan = 1, [steps], dict(counts), []
    used = waste = 0

    def room(largest: int, steps: list[int], one: bool = False) -> list[tuple[int, ...]]:
        rest = {k: v - (k == largest) for k, v in left.items() if v > (k == largest)}
        return fillings(capacity - largest, sorted(rest, reverse=True), rest, steps, one)

    def contents(largest: int) -> Iterator[tuple[int, ...]]:
        soon = [min(SOON, left_steps[0])]
        before = soon[0]
        first = room(largest, soon, one=True)[0]
        left_steps[0] -= before - max(soon[0], 0)
        yield first
        items, sizes = array("i"), array("i")  # tuples of all would be ten times as large
        for filling in room(largest, left_steps):
            if filling != first:
                items.extend(filling)
                sizes.append(len(filling))
        at = 0
        for size in sizes:
            yield tuple(items[at : at + size])
            at += size

    def ways() -> Iterator[tuple[int, tuple[int, ...]]]:
        largest = max(left)
        for items in contents(largest):
            content = (largest, *items)
            need = Counter(content)
            for times in range(min(left[x] // n for x, n in need.items()), 0, -1):
                yield times, content

    def take(times: int, content: tuple[int, ...]) -> None:
        """Of what is left; with times below 0, back."""
        nonlocal used, waste, total_left
        for x in content:
            left[x] = left.get(x, 0) - times
            if not left[x]:
                del left[x]
        used, waste, total_left = used + times, waste + times * (capacity - sum(content)), total_left - times * sum(content)

    def back() -> None:
        times, content = plan.pop()
        take(-times, content)

    total_left = total
    stack = [ways()] if fewest > bound and nodes > 0 and steps > 0 else []
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if plan:
                back()
            continue
        take(*step)
        plan.append(step)
        if used + -(-total_left // capacity) >= fewest or waste > (fewest - 1) * capacity - total:
            back()
            continue
        if not left:
            fewest, best = used, plan[::-1]
            if fewest == bound:
                break
            back()
            continue
        opened += 1
        if opened > nodes or left_steps[0] <= 0:
            break
        stack.append(ways())
    return best


def _places(plan: Plan) -> dict[str, np.ndarray]:
    """For each length, which of its numbers go where: `each` in a sequence,
    from sequence `base`, from offset `offset`."""
    rows, base, seen = [], 0, {}
    for times, content in sorted(plan, key=lambda p: (p[1], p[0]), reverse=True):
        offset = 0
        for length in sorted(set(content), reverse=True):
            each = content.count(length)
            rows.append((length, seen.get(length, 0), each, base, offset))
            seen[length] = seen.get(length, 0) + each * times
            offset += each * length
        base += times
    rows.sort()
    table = np.array(rows or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    return {"key": table[:, 0] << 44 | table[:, 1], "each": table[:, 2], "base": table[:, 3], "offset": table[:, 4], "low": table[:, 1]}


def _place(batches: Iterator[pa.RecordBatch], places: object) -> Iterator[pa.RecordBatch]:
    table = places.value
    for batch in batches:
        if not batch.num_rows:
            continue
        length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
        at = np.searchsorted(table["key"], length << 44 | number, side="right") - 1
        beyond = number - table["low"][at]
        sequence = table["base"][at] + beyond // table["each"][at]
        offset = table["offset"][at] + beyond % table["each"][at] * length
        kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(parts: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, steps: int = STEPS) -> DataFrame:
    """Pieces with sequence_id and offset. Pieces of one length are alike, so
    which of them goes where is settled by (doc_id, piece), null ids first;
    repeated rows are pieces of their own, and which of them goes where is
    open. No pieces, no sequences."""
    spark = parts.sparkSession
    parts = written(parts, "pieces")
    total = parts.count()
    buckets = max(16, min(4096, total // 200_000))
    parts = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = written(parts.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "lengths")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(_places(complete_bins(counts, capacity, nodes, steps)))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1
    numbered = parts.withColumn("_in", number.cast("long")).join(starts, ["length", "_bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_in") + F.col("_before")).alias("number"))
    return numbered.mapInArrow(partial(_place, places=places), PIECES + ", sequence_id long, offset long")
