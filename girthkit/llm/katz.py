"""Language-model scoring with a Katz back-off model of the corpus.

Counts live in partitioned tables. A block of documents (a scan partition, cut
where it passes BLOCK tokens) asks for its distinct n-grams only, as sorted
64-bit hashes in compressed blobs, dealt by hash range. A range adds up its
blobs and answers every block with the corpus counts in the order of its
question, so answers carry no keys, and says which n-grams no other block
asked for. A longer n-gram that holds such a one occurs in this block alone, so
its count, and its weight as a context, are known here and need not be asked.
Good-Turing discounts come from the counts of counts (a few rows). Back-off
weights are normalised exactly: each distinct n-gram is owned by one block,
which adds its lower-order probability to its context's sum; the ranges of
contexts divide the mass that is left by the lower-order mass of what was not
seen. Scoring evaluates the recursion

    P(w | h) = d(c) c(h w) / c(h)        if h w was seen
             = alpha(h) P(w | h')        otherwise

on every token. Pass one asks for the counts of orders 1 and 2, pass n for the
weights of order n and the counts of order n + 1, the last one scores. Every
pass reads the texts anew; what moves between tasks are distinct n-grams that
blocks share, never the texts, and a pass's shuffle files go when it ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import brief_shuffles, by_block, by_range, edges, fetch, fetched, hash_bits, merge, same_scan
from .common import delete, fresh_path, held_out
from .words import Texts, Words, chunks, mix, pack, squeeze, stretch, unique

#: Tokens of a block, counts up to which Good-Turing discounts.
BLOCK = 1_200_000
DISCOUNTED = 5

_STEP = np.uint64(0x9FB21C651E98DF25)
_START, _END = mix(np.array([0x5354415254, 0x454E44], np.uint64))


def discounts(seen: list[int]) -> np.ndarray:
    """Katz's discount of each count 0..k+1 from the numbers of n-grams seen
    1..k+1 times; the last stands for all higher counts. k is lowered until
    all lie in (0, 1]; with no such k nothing is discounted."""
    for k in range(len(seen) - 1, 0, -1):
        n = [0, *seen[: k + 1]]
        if not all(n[1:]):
            continue
        cut = (k + 1) * n[k + 1] / n[1]
        if cut >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            return np.array([0.0, *d, 1.0])
    return np.array([0.0, 1.0])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, len(d) - 1)] * counts


class Block:
    """The token positions of some documents: for each order the hash of the
    n-gram that ends there, and the distinct ones."""

    def __init__(self, ids: list, held: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], order: int):
        self.ids, self.held = ids, held
        sizes = np.concatenate([s for s, _ in parts]) + 1  # the closing token
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        word = np.full(self.first[-1], _END, np.uint64)
        inner = np.ones(len(word), bool)
        inner[self.first[1:] - 1] = False
        word[inner] = np.concatenate([h for _, h in parts])
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.begin = np.zeros(len(word), bool)
        self.begin[self.first[:-1]] = True
        gram, self.distinct = word, [_distinct(word)]
        for _ in range(1, order):
            context = np.empty_like(word)
            context[1:] = gram[:-1]
            context[self.begin] = _START
            with np.errstate(over="ignore"):
                gram = mix(context * _STEP + word)
            self.distinct.append(_distinct(gram))

    def local(self, n: int) -> np.ndarray:
        """Training count of each distinct n-gram in this block."""
        keys, _, codes = self.distinct[n - 1]
        return np.bincount(codes, (~self.held)[self.owner], len(keys)).astype(np.int64)

    def shared(self, n: int, alone: np.ndarray) -> np.ndarray:
        """Distinct n-grams that other blocks may hold too: those whose first
        and last n-1 tokens both are not alone in this block."""
        at, lower = self.distinct[n - 1][1], self.distinct[n - 2][2]
        return ~(alone[lower[at]] | (~self.begin[at] & alone[lower[at - 1]]))

    def contexts(self, n: int, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted contexts of order n, the context of each position, whether
        another block may hold the context): (n-1)-grams, and the start."""
        keys, _, lower = self.distinct[n - 2]
        place = int(np.searchsorted(keys, _START))
        codes = np.empty_like(lower)
        codes[1:] = lower[:-1]
        codes += codes >= place
        codes[self.begin] = place
        used = np.zeros(len(keys) + 1, bool)
        used[codes] = True
        return np.insert(keys, place, _START), codes, used & ~np.insert(alone, place, False)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at, codes = unique(values)
    return keys, at.astype(np.int32), codes.astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, Block]]:
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    ids, held, parts, tokens = [], [], [], 0
    for batch in chunks(batches):
        words = Words(Texts(batch.column("text")))
        ids += batch.column("doc_id").to_pylist()
        held.append(batch.column("held_out").to_numpy(zero_copy_only=False))
        parts.append((np.diff(words.first), words.hash))
        tokens += len(words.hash) + len(words.texts)
        if tokens > BLOCK:
            yield task << 20 | number, Block(ids, np.concatenate(held), parts, order)
            ids, held, parts, tokens, number = [], [], [], 0, number + 1
    if ids:
        yield task << 20 | number, Block(ids, np.concatenate(held), parts, order)


ASKED = "n int, part int, block long, keys binary, first binary, numbers binary, stats array<long>"
ANSWER = "n int, part int, block long, answer binary, stats array<long>"


def _rows(n: int, block: int, bits: int, keys: np.ndarray, first: np.ndarray, numbers: np.ndarray | None = None, stats: list[int] | None = None) -> list[tuple]:
    """A block's question about order n, a row a range; the block's own
    statistics go to one of the ranges."""
    at = edges(keys, bits).tolist()
    own = block % (1 << bits) if stats else -1
    return [
        (n, p, block, pack(keys[a:b]), squeeze(first[a:b]), None if numbers is None else squeeze(numbers[a:b].T.ravel()), stats if p == own else None)
        for p, (a, b) in enumerate(zip(at, at[1:]))
        if b > a or p == own
    ]


def _stats(counts: np.ndarray) -> list[int]:
    """Tokens, n-grams, and n-grams seen 1 .. DISCOUNTED + 1 times."""
    seen = np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return [int(counts.sum()), int((counts > 0).sum()), *seen[1 : DISCOUNTED + 2].tolist()]


def _ask(batches: Iterator[pa.RecordBatch], step: int, order: int, bits: int, model: Model | None) -> Iterator[pa.RecordBatch]:
    """Pass `step`: counts of the order after it (in the first, of both), and
    weights of order `step`, for which lower orders are answered already."""
    top = min(step + 1, order)
    for block, own in _blocks(batches, top):
        if model is None:
            rows = [x for n in range(1, top + 1) for x in _rows(n, block, bits, own.distinct[n - 1][0], own.local(n).astype(np.int32))]
        else:
            known = _known(model, block, own, step)
            lower = _probabilities(model, block, own, known, step - 1)
            keys, after, asked, sums, numbers = _sums(own, step, known, lower)
            # a back-off weight is told only where an unseen n-gram asks for it
            unseen = known[step - 1][0][own.distinct[step - 1][2]] == 0
            need = np.zeros(len(keys), np.int32)
            need[after[unseen]] = 1
            rows = _rows(step, block, bits, keys[asked], sums[asked], np.column_stack([numbers, need])[asked])
            if top > step:
                asked, counts = own.shared(top, known[step - 1][2]), own.local(top)
                rows += _rows(top, block, bits, own.distinct[top - 1][0][asked], counts[asked].astype(np.int32), stats=_stats(counts[~asked]))
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in ASKED.split(", ")])


def _answer(key: tuple, table: pa.Table, step: int, model: Model | None) -> pa.Table:
    n, part = (k.as_py() for k in key)
    table, codes, first, cuts = merge(table)
    blocks = table.column("block").to_pylist()
    if model is not None and n == step:
        sums = np.bincount(codes, np.concatenate([stretch(b, np.float64) for b in table.column("first").to_pylist()]), len(first))
        *numbers, need = np.concatenate([stretch(b, np.int32).reshape(DISCOUNTED + 2, -1) for b in table.column("numbers").to_pylist()], axis=1)
        pairs = _weights(model, n, sums, np.stack([np.bincount(codes, row, len(first)) for row in numbers], axis=1))
        told = [np.stack([pairs[c, 0], pairs[c, 1] * m], axis=1) for c, m in zip(np.split(codes, cuts), np.split(need, cuts))]
        blobs, stats = [squeeze(x.T.ravel()) for x in told], []
    else:
        counts = np.concatenate([stretch(b, np.int32) for b in table.column("first").to_pylist()])
        totals = np.bincount(codes, counts, len(first)).astype(np.int64)
        alone = np.bincount(codes, minlength=len(first)) == 1
        mine = np.zeros(len(codes), np.int64)
        mine[first] = 1  # the first block to ask owns the n-gram
        word = totals * 4 + alone
        blobs = [squeeze(word[c] + 2 * m) for c, m in zip(np.split(codes, cuts), np.split(mine, cuts))]
        own = [s for s in table.column("stats").to_pylist() if s]
        stats = [np.sum([_stats(totals), *own], axis=0).tolist()]
    more = [None] * len(stats)
    size = len(blocks) + len(stats)
    return pa.table([pa.array([n] * size, pa.int32()), pa.array([part] * size, pa.int32()), pa.array(blocks + [-1] * len(stats), pa.int64()), pa.array(blobs + more, pa.binary()), pa.array([None] * len(blocks) + stats, pa.list_(pa.int64()))], ["n", "part", "block", "answer", "stats"])


class Model:
    """Totals and discounts of each order (a few numbers), and the folders of
    the answers of each pass: pass n holds the back-off weights of order n and
    the counts of order n + 1, the first one the counts of orders 1 and 2."""

    def __init__(self, order: int, answers: list[str], stats: dict[int, list[int]]):
        self.order, self.answers = order, answers
        self.tokens, self.types = stats[1][0], stats[1][1]
        self.discounts = {n: discounts(s[2:]) for n, s in stats.items()}
        d, seen = self.discounts[1], stats[1][2:]
        left = sum((1 - d[min(r, len(d) - 1)]) * r * k for r, k in enumerate(seen, 1))
        # nothing discounted: one more token, an unknown one, is counted
        self.bottom = self.tokens if left > 0 else self.tokens + 1
        self.unknown = left / self.tokens if left > 0 else 1 / (self.tokens + 1)


Known = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _known(model: Model, block: int, own: Block, upto: int) -> Known:
    """(corpus count, owned here, in no other block) of the block's distinct
    n-grams, by order."""
    out: Known = []
    for n in range(1, upto + 1):
        got = fetch(model.answers[max(n - 2, 0)], block, n, np.int64)
        size = len(own.distinct[n - 1][0])
        asked = own.shared(n, out[-1][2]) if n > 2 else np.ones(size, bool)
        if len(got) != np.count_nonzero(asked):
            raise RuntimeError("the texts came in another order than before; write them to a table first")
        count, mine, alone = own.local(n) if n > 2 else np.zeros(size, np.int64), np.ones(size, bool), np.ones(size, bool)
        count[asked], mine[asked], alone[asked] = got >> 2, got & 2, got & 1
        out.append((count, mine, alone))
    return out


def _sums(own: Block, n: int, known: Known, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts of order n, context of each position, contexts to ask for,
    lower-order mass of the owned n-grams that follow each context, their
    counts' sum and how many are seen 1 .. DISCOUNTED times)."""
    contexts, codes, asked = own.contexts(n, known[n - 2][2])
    count, mine, _ = known[n - 1]
    mine = mine & (count > 0)
    at, count = own.distinct[n - 1][1][mine], count[mine]
    after = codes[at]
    sums = np.bincount(after, lower[at], len(contexts))
    numbers = np.zeros((len(contexts), DISCOUNTED + 1), np.int32)
    numbers[:, 0] = np.bincount(after, count, len(contexts))
    for r in range(1, DISCOUNTED + 1):
        numbers[:, r] = np.bincount(after[count == r], minlength=len(contexts))
    return contexts, codes, asked, sums, numbers


def _weights(model: Model, n: int, sums: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """(denominator, back-off weight) of contexts from their sums."""
    d, (total, *by_count) = model.discounts[n], numbers.T
    cut = sum(((1 - d[min(r, len(d) - 1)]) * r * m for r, m in enumerate(by_count, 1)), np.zeros(len(sums)))
    # a context whose counts are all undiscounted: one more token is counted
    bottom = np.where(cut > 0, total, total + 1)
    left = np.where(cut > 0, cut, 1.0) / np.maximum(bottom, 1)
    alpha = np.where(total > 0, left / np.maximum(1 - sums, model.unknown), 1.0)
    return np.stack([bottom, alpha], axis=1)


def _probabilities(model: Model, block: int, own: Block, known: Known, upto: int) -> np.ndarray:
    """Probability of each token by the model of an order, by recursion."""
    count = known[0][0]
    single = np.where(count > 0, discounted(count, model.discounts[1]) / model.bottom, model.unknown)
    p = single[own.distinct[0][2]]
    for n in range(2, upto + 1):
        _, codes, asked, sums, numbers = _sums(own, n, known, p)
        weights = _weights(model, n, sums, numbers)
        weights[asked] = np.concatenate([x.reshape(2, -1).T for x in fetched(model.answers[n - 1], block, n, np.float64)])
        count = known[n - 1][0][own.distinct[n - 1][2]]
        bottom, alpha = weights[codes, 0], weights[codes, 1]
        seen = discounted(count, model.discounts[n]) / np.maximum(bottom, 1)
        p = np.where(count > 0, seen, alpha * p)
    return p


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for block, own in _blocks(batches, model.order):
        known = _known(model, block, own, model.order)
        docs = len(own.ids)
        add = lambda x: np.bincount(own.owner, x, docs)
        count = known[0][0][own.distinct[0][2]]
        base = np.log10((count + 1) / (model.tokens + model.types + 1))
        score = np.log10(_probabilities(model, block, own, known, model.order))
        columns = [pa.array(own.ids, pa.int64()), pa.array(own.held), pa.array(np.diff(own.first)), pa.array(add(count > 0).astype(np.int64)), pa.array(np.full(docs, model.tokens, np.int64)), pa.array(add(base)), pa.array(add(score))]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])


def katz_scores(df: DataFrame, order: int = 2, key: str = "doc_id", text: str = "text", held: tuple[int, int] = (7, 2)) -> DataFrame:
    """Learn from the rows that are not held out and score every row.

    df is a table (read from files): its rows must come in the same order in
    every pass, which is checked. Null texts count as empty; such a text has
    one token, its end. Null keys are learned from. Words that were not
    learned share one unknown class, so the probabilities of all known words
    and it add up to 1 after any context. An empty table gives no rows.
    """
    spark = df.sparkSession
    with same_scan(spark), brief_shuffles(spark):
        docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(key), *held).alias("held_out"))
        bits = hash_bits(docs)
        found: dict[int, list[int]] = {n: [0] * (DISCOUNTED + 3) for n in range(1, order + 1)}
        answers: list[str] = []
        model = None
        for step in range(1, max(order, 1) + 1):
            asked = docs.mapInArrow(partial(_ask, step=step, order=order, bits=bits, model=model), ASKED)
            told = by_range(asked, bits, 2).groupBy("n", "part").applyInArrow(_keyed(partial(_answer, step=step, model=model)), ANSWER)
            answers.append(by_block(told, docs, "katz"))
            stats = spark.read.schema(f"{ANSWER}, bucket long").parquet(answers[-1]).filter("bucket = -1").select("n", F.posexplode("stats").alias("k", "v"))
            for r in stats.groupBy("n", "k").agg(F.sum("v").alias("v")).collect():  # eight numbers an order
                found[r.n][r.k] = r.v
            model = Model(order, answers, found)
        path = fresh_path(spark, "scores")
        docs.mapInArrow(partial(_score, model=model), SCORES).write.parquet(path)
    for folder in answers:
        delete(spark, folder)
    return spark.read.schema(SCORES).parquet(path)


def _keyed(answer: partial) -> object:
    def call(key: tuple, table: pa.Table) -> pa.Table:
        return answer(key, table)

    return call
