"""Toxicity: a bidirectional gated recurrent network with attention pooling,
trained in numpy, that scores every overlapping window of a text.

A word enters as a word input (a trained vector if the training sample has it
in enough places, and how far it leans to toxic texts there) and as a
character input (the mean of trained vectors of its hashed character trigrams,
and the furthest lean of its runs of five bytes, which also reaches inflected
forms that the sample does not have). What a word adds to the gates is a function of the word alone, so
it is computed once for each distinct word of a chunk and scoring pays for the
recurrence only. A document scores as its highest window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .words import LOWER, Texts, Words, chunks, hashes, mix, release

WINDOW, STRIDE = 32, 16
#: Labelled rows that training reads at most, by a hash of their id; half of
#: them toxic where there are as many.
SAMPLE = 2400
#: Bytes of text that training reads at most.
SAMPLE_BYTES = 8 << 20
HIDDEN, WORD_DIM, CHAR_DIM, WORD_ROWS, CHAR_ROWS = 8, 6, 4, 1 << 12, 1 << 11
#: Different neighbours that a word must have in the sample for a vector.
PLACES = 20
#: Bytes of the runs whose lean is learned.
GRAM = 5
THRESHOLD = 0.7
#: Windows that are scored at once.
AT_ONCE = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Weights and the forward and backward passes. Arrays: x (steps, batch,
    inputs), mask (steps, batch)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        inputs = WORD_DIM + CHAR_DIM + 2
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.w = {"word": draw(WORD_ROWS, WORD_DIM) * 0.3, "char": draw(CHAR_ROWS, CHAR_DIM) * 0.3}
        for side in "fb":
            self.w |= {f"{side}x": draw(inputs, 3 * HIDDEN), f"{side}h": draw(HIDDEN, 3 * HIDDEN), f"{side}c": np.zeros(3 * HIDDEN, np.float32)}
        self.w |= {"a": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN), "o": draw(2 * HIDDEN), "c": np.full(1, -1, np.float32)}

    def scan(self, side: str, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction, in the order of the steps. gates:
        what the inputs add to the gates."""
        steps, batch = mask.shape
        h = np.zeros((batch, HIDDEN), np.float32)
        out = np.empty((steps, batch, HIDDEN), np.float32)
        wide = 2 * HIDDEN
        u = self.w[f"{side}h"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            zr = _sigmoid(gates[t, :, :wide] + h @ u[:, :wide])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            rh = r * h
            n = np.tanh(gates[t, :, wide:] + rh @ u[:, wide:])
            m = mask[t][:, None]
            new = h + m * z * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, rh, n, m))
            h = new
            out[t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Probability of each window by attention over its states."""
        e = np.tanh(states @ self.w["a"])
        s = e @ self.w["v"] + (mask - 1) * 1e4
        s -= s.max(axis=0)
        a = np.exp(s) * (mask + 1e-9)
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        return _sigmoid(pooled @ self.w["o"] + self.w["c"][0]), (e, a, pooled)

    def score(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.scan("f", forward, mask), self.scan("b", backward, mask)], axis=2)
        return self.pool(states, mask)[0]

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss, gradients of the weights, and of the inputs."""
        w, kept = self.w, {"f": [], "b": []}
        gates = {s: x @ w[f"{s}x"] + w[f"{s}c"] for s in "fb"}
        states = np.concatenate([self.scan(s, gates[s], mask, kept[s]) for s in "fb"], axis=2)
        p, (e, a, pooled) = self.pool(states, mask)
        loss = float(-(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).mean())
        d = (weight * (p - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
        dp = d[:, None] * w["o"]
        da = (states * dp).sum(axis=2)
        ds = a * (da - (a * da).sum(axis=0))
        de = ds[:, :, None] * w["v"] * (1 - e**2)
        g["v"] = np.einsum("tb,tbk->k", ds, e)
        g["a"] = np.einsum("tbi,tbk->ik", states, de)
        dstates = a[:, :, None] * dp + de @ w["a"].T
        dx = np.zeros_like(x)
        wide = 2 * HIDDEN
        for s, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, wide))):
            u, dgates, dh = w[f"{s}h"], np.empty_like(gates[s]), np.zeros((x.shape[1], HIDDEN), np.float32)
            du = np.zeros_like(u)
            for t, h, z, r, rh, n, m in reversed(kept[s]):
                dh = dh + dstates[t, :, part]
                dn = dh * m * z * (1 - n**2)
                dz = dh * m * (n - h) * z * (1 - z)
                drh = dn @ u[:, wide:].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                du[:, :wide] += h.T @ dzr
                du[:, wide:] += rh.T @ dn
                dh = dh * (1 - m * z) + drh * r + dzr @ u[:, :wide].T
                dgates[t] = np.concatenate([dzr, dn], axis=1)
            g |= {f"{s}h": du, f"{s}x": np.einsum("tbi,tbg->ig", x, dgates), f"{s}c": dgates.sum(axis=(0, 1))}
            dx += dgates @ w[f"{s}x"].T
        return loss, g, dx


class Leans:
    """Sorted hashes and how far what they stand for leans to toxic texts; row:
    of the vector table (row 0: none of its own)."""

    def __init__(self, keys: np.ndarray, lean: np.ndarray, row: np.ndarray | None = None):
        self.keys, self.lean, self.row = keys, lean.astype(np.float32), row

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lean, row), 0 for what is not known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.lean[at], 0).astype(np.float32), np.where(known, self.row[at], 0) if self.row is not None else None


def char_grams(low: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of every run of `width` bytes of words with a mark before
    them; a shorter word has one run, padded."""
    per = np.maximum(end - begin + 2 - width, 1)
    word = np.repeat(np.arange(len(begin)), per)
    start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + begin[word] - 1
    code = np.zeros(len(word), np.uint64)
    for k in range(width):
        at = start + k
        byte = low[np.clip(at, 0, max(len(low) - 1, 0))].astype(np.uint64) if len(low) else np.zeros(len(word), np.uint64)
        code = code * np.uint64(257) + np.where(at < begin[word], 94, np.where(at < end[word], byte, 0)).astype(np.uint64)
    return mix(code), word


class Vocabulary:
    """The distinct words of a chunk without the marks at their ends: row of
    the word table, leans of the word and of its runs of bytes, and the rows
    of its trigrams as (row, word) pairs."""

    def __init__(self, words: Words, inputs: tuple[Leans, Leans]):
        bare, begin, end = bare_words(words)
        self.keys, at, self.codes = np.unique(bare, return_index=True, return_inverse=True)
        begin, end, low = begin[at], end[at], LOWER[words.texts.data]
        lean, self.rows = inputs[0].of(self.keys)
        grams, word = char_grams(low, begin, end, GRAM)
        own, furthest = inputs[1].of(grams)[0], np.zeros(len(at), np.float32)
        np.maximum.at(furthest, word, own)
        self.lean = np.stack([lean, furthest], axis=1)
        grams, self.gram_word = char_grams(low, begin, end, 3)
        self.gram_rows = (grams >> np.uint64(40)).astype(np.int64) % CHAR_ROWS
        self.gram_count = np.bincount(self.gram_word, minlength=len(at)).astype(np.float32)

    def only(self, words: np.ndarray) -> Vocabulary:
        """The same for some of the words (sorted places)."""
        part = object.__new__(Vocabulary)
        part.rows, part.lean, part.gram_count = self.rows[words], self.lean[words], self.gram_count[words]
        a, b = np.searchsorted(self.gram_word, words), np.searchsorted(self.gram_word, words, side="right")
        grams = b - a
        part.gram_word = np.repeat(np.arange(len(words)), grams)
        part.gram_rows = self.gram_rows[np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams) + a[part.gram_word]]
        return part

    def vectors(self, net: Net) -> np.ndarray:
        char = np.stack([np.bincount(self.gram_word, net.w["char"][self.gram_rows, k], len(self.rows)) for k in range(CHAR_DIM)], axis=1) / self.gram_count[:, None]
        return np.concatenate([net.w["word"][self.rows], char, self.lean], axis=1).astype(np.float32)


_MARK = np.ones(256, bool)
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def bare_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each word without the marks around it."""
    data = words.texts.data
    begin, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        begin += (begin < end - 1) & _MARK[data[begin]]
        end -= (end > begin + 1) & _MARK[data[end - 1]]
    return hashes(LOWER[data], begin, end), begin, end


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window: each begins STRIDE words
    after the one before, the last reaches the end of its text; a text without
    words has one empty window."""
    counts = np.diff(first)
    per = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(counts)), per)
    begin = (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    return owner, begin + first[:-1][owner], np.clip(counts[owner] - begin, 0, WINDOW)


def _grid(begin: np.ndarray, size: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    at = begin[None, :] + np.arange(WINDOW)[:, None]
    mask = (np.arange(WINDOW)[:, None] < size[None, :]).astype(np.float32)
    return np.minimum(at, max(words - 1, 0)), mask


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 10, seed: int = 7) -> tuple[Net, tuple[Leans, Leans]]:
    """Fit net and word leans to labelled texts. Each text takes part with the
    window that leans most (later: that scores highest) and, if it is clean,
    with one drawn at random. Without both classes the net stays as drawn,
    with a bias that makes it score low."""
    net, rng = Net(seed), np.random.default_rng(seed)
    words = Words(Texts(pa.array(texts, pa.large_string())))
    if not len(words.start) or labels.min() == labels.max():
        net.w["c"][:] = 3 if len(labels) and labels.min() == 1 else -3
        net.w["o"][:] = 0
        return net, (Leans(np.zeros(0, np.uint64), np.zeros(0)),) * 2
    inputs = learn_words(words, labels)
    vocabulary = Vocabulary(words, inputs)
    codes = vocabulary.codes
    own, begin, size = windows(words.first)
    texts_of = np.arange(len(labels))
    total = np.concatenate([[0.0], np.cumsum(np.maximum(vocabulary.lean[codes].max(axis=1), 0))])
    worth = total[begin + size] - total[begin]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    count = 0
    for epoch in range(epochs):
        if epoch in (epochs // 2, epochs - 2):  # from here on the windows that score highest
            worth = _window_scores(net, vocabulary, begin, size)
        order = np.lexsort((rng.random(len(own)), worth, own))
        best = order[np.searchsorted(own[order], texts_of, side="right") - 1]
        drawn = np.searchsorted(own, texts_of) + (rng.random(len(labels)) * np.bincount(own)).astype(np.int64)
        picked = np.concatenate([best, drawn[labels == 0]])
        y = np.concatenate([labels, np.zeros(int((labels == 0).sum()))]).astype(np.float32)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
        order = rng.permutation(len(picked))
        for a in range(0, len(order), 128):
            use = order[a : a + 128]
            at, mask = _grid(begin[picked[use]], size[picked[use]], len(codes))
            words_here, which = np.unique(codes[at], return_inverse=True)
            which = which.reshape(at.shape)
            part = vocabulary.only(words_here)
            _, g, dx = net.step(part.vectors(net)[which], mask, y[use], weight[use])
            dword = np.stack([np.bincount(which.ravel(), dx[:, :, k].ravel(), len(words_here)) for k in range(dx.shape[2])], axis=1)
            g["word"] = np.zeros_like(net.w["word"])
            np.add.at(g["word"], part.rows, dword[:, :WORD_DIM])
            g["word"][0] = 0
            g["char"] = np.zeros_like(net.w["char"])
            np.add.at(g["char"], part.gram_rows, (dword[:, WORD_DIM : WORD_DIM + CHAR_DIM] / part.gram_count[:, None])[part.gram_word])
            count += 1
            for k, v in net.w.items():  # Adam with weight decay
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= 0.01 * ((m / (1 - 0.9**count)) / (np.sqrt(s / (1 - 0.99**count)) + 1e-7) + 0.01 * v)
    return net, inputs


def _leans(toxic: np.ndarray, clean: np.ndarray, least: float) -> np.ndarray:
    """Log ratio of the rates, 0 unless the likelihood ratio is `least`."""
    share = toxic.sum() / max(toxic.sum() + clean.sum(), 1)
    both = toxic + clean
    term = lambda x, p: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(both * p, 1e-9)), 0)
    sure = 2 * (term(toxic, share) + term(clean, 1 - share)) > least
    lean = np.log((toxic + 0.5) / (toxic.sum() + 1)) - np.log((clean + 0.5) / (clean.sum() + 1))
    return np.where(sure, np.clip(lean, -4, 4), 0)


def learn_words(words: Words, labels: np.ndarray) -> tuple[Leans, Leans]:
    """Leans and vector rows of the sample's words, and leans of their runs of
    bytes. A word counts once for each different word before it, so copies of
    a text add nothing: only words that stand in many places of toxic texts
    and of few others lean far."""
    bare, begin, end = bare_words(words)
    owner = words.owner()
    keys, at, codes = np.unique(bare, return_index=True, return_inverse=True)
    before = np.concatenate([[np.uint64(0)], bare[:-1]])
    before[words.first[:-1][words.first[:-1] < len(bare)]] = 0
    with np.errstate(over="ignore"):
        place = mix(before * np.uint64(0x9FB21C651E98DF25) + bare)
    side = labels[owner] > 0
    seen = []
    for mine in (side, ~side):
        _, first = np.unique(place[mine], return_index=True)
        seen.append(np.bincount(codes[mine][first], minlength=len(keys)))
    toxic, clean = seen
    lean = _leans(toxic, clean, 16)
    rank = np.argsort(np.lexsort((keys, -(toxic + clean))))
    row = np.where((toxic + clean >= PLACES) & (rank < WORD_ROWS - 1), rank + 1, 0)
    kept = (lean != 0) | (row > 0)
    grams, word = char_grams(LOWER[words.texts.data], begin[at], end[at], GRAM)
    runs, which = np.unique(grams, return_inverse=True)
    run_lean = _leans(np.bincount(which, toxic[word], len(runs)), np.bincount(which, clean[word], len(runs)), 22)
    return Leans(keys[kept], lean[kept], row[kept]), Leans(runs[run_lean > 1], run_lean[run_lean > 1])


def _window_scores(net: Net, vocabulary: Vocabulary, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    vectors = vocabulary.vectors(net)
    if not len(vectors):
        vectors = np.zeros((1, WORD_DIM + CHAR_DIM + 2), np.float32)
    codes = vocabulary.codes if len(vocabulary.codes) else np.zeros(1, np.int64)
    forward, backward = (vectors @ net.w[f"{s}x"] + net.w[f"{s}c"] for s in "fb")
    out = np.empty(len(begin), np.float32)
    for a in range(0, len(begin), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        at, mask = _grid(begin[part], size[part], len(codes))
        which = codes[at]
        out[part] = net.score(forward[which], backward[which], mask)
    return out


def _scores(batches: Iterator[pa.RecordBatch], model: tuple[Net, tuple[Leans, Leans]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    net, inputs = model
    for batch in chunks(batches, limit=2 << 20):
        words = Words(Texts(batch.column("text")))
        owner, begin, size = windows(words.first)
        best = np.zeros(batch.num_rows, np.float32)
        np.maximum.at(best, owner, _window_scores(net, Vocabulary(words, inputs), begin, size))
        yield batch, best.astype(np.float64)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _score(batches: Iterator[pa.RecordBatch], model: object, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, best in _scores(batches, model.value):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best), pa.array((best >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def _clean(batches: Iterator[pa.RecordBatch], model: object, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, best in _scores(batches, model.value):
        yield batch.filter(pa.array(best < threshold))


def _train(frames: Iterator, epochs: int) -> Iterator:
    import pickle

    import pandas as pd

    got = pd.concat(list(frames), ignore_index=True)  # one task, at most `most` bytes of text
    model = train(got["text"].tolist(), got["toxic"].to_numpy(np.float64), epochs)
    yield pd.DataFrame({"model": [pickle.dumps(model)]})
    release()


def fit(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (3, 1), sample: int = SAMPLE, most: int = SAMPLE_BYTES, epochs: int = 10) -> tuple[Net, tuple[Leans, Leans]]:
    """Train on at most `sample` labelled rows that are not held out, chosen by
    a hash of the id, and at most `most` bytes of their texts (half for each
    class; a text of more than a sixteenth of it takes no part). Null labels
    do not count; of several labels of an id the largest does; of an id's
    several rows each counts. One executor task trains; the driver gets the
    fitted arrays, whose size is fixed."""
    import pickle

    spark = docs.sparkSession
    rows = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"), *held))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    mixed = F.xxhash64("doc_id", F.lit(8))
    chosen = []
    for value in (1, 0):  # at most `sample` ids altogether
        chosen += rows.filter(F.col("toxic") == value).orderBy(mixed).limit(sample // 2).collect()
    few = F.broadcast(spark.createDataFrame([(r.doc_id, int(r.toxic)) for r in chosen], "doc_id long, toxic int"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(size <= most // 16).join(few, "doc_id")
    got = got.orderBy(mixed, "text").limit(2 * sample)
    spent = F.sum(size).over(Window.partitionBy("toxic").orderBy(mixed, "text").rowsBetween(Window.unboundedPreceding, 0))
    got = got.withColumn("spent", spent).filter(F.col("spent") <= most // 2).select("doc_id", "text", "toxic")
    got = got.repartition(1).sortWithinPartitions("doc_id", "text")
    found = got.mapInPandas(partial(_train, epochs=epochs), "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else train([], np.zeros(0))


def score_documents(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (3, 1), threshold: float = THRESHOLD) -> DataFrame:
    """Score of every row, 0 to 1. Null and empty texts have one empty window,
    which scores by the net's bias. Null ids are scored and not held out."""
    model = small_batches(docs.sparkSession).sparkContext.broadcast(fit(docs, labels, held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), *held).alias("held_out"))
    return rows.mapInArrow(partial(_score, model=model, threshold=threshold), SCHEMA)


def keep_clean(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (3, 1), threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score `threshold` or more."""
    model = small_batches(docs.sparkSession).sparkContext.broadcast(fit(docs, labels, held))
    return docs.mapInArrow(partial(_clean, model=model, threshold=threshold), docs.schema)
