"""Quality classifier: ridge regression on random Fourier features of document
statistics, calibrated by isotonic regression.

One pass over the texts gives a few statistics a document. Cosines of random
projections of the standardised statistics approximate a Gaussian kernel. The
normal equations are sums over rows, so every task adds up its own part and
the parts are added by row of the matrix; the driver solves a system of fixed
size. Isotonic regression of the labels on the scores needs the labels' counts
on a grid of scores only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, written
from .words import Texts, Words, chunks

FEATURES = 256
RIDGE = 1.0
GRID = 2000
THRESHOLD = 0.7
SEED = 11

NAMES = (
    "log_words", "word_length", "word_spread", "long_words", "distinct", "repeat_next", "upper", "digits", "marks", "odd_marks", "bars",
    "line_ends", "stops", "high_bytes", "short_words", "capital_words", "exclaims", "line_words", "repeat_two", "top_word",
)


def _table(byte_set: bytes) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(byte_set)] = 1
    return out


_KINDS = {
    "upper": _table(bytes(range(65, 91))),
    "digits": _table(bytes(range(48, 58))),
    "marks": _table(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])),
    "odd_marks": _table(b"#$%&*<>@^_~{}[]\\/=+"),
    "bars": _table(b"|"),
    "line_ends": _table(b"\n"),
    "stops": _table(b".?"),
    "exclaims": _table(b"!"),
    "high_bytes": _table(bytes(range(128, 256))),
}


def statistics(texts: Texts) -> np.ndarray:
    """One row of NAMES a text, all numbers finite; of an empty text all 0."""
    words = Words(texts)
    docs, owner = len(texts), words.owner()
    count = np.diff(words.first).astype(np.float64)
    per_word = np.maximum(count, 1)
    size = np.maximum(np.diff(texts.offsets), 1).astype(np.float64)
    add = lambda x: np.bincount(owner, x, docs)
    length = (words.end - words.start).astype(np.float64)
    out = {"log_words": np.log1p(count), "word_length": add(length) / per_word}
    out["word_spread"] = np.sqrt(np.maximum(add(length**2) / per_word - out["word_length"] ** 2, 0))
    out["long_words"], out["short_words"] = add(length > 16) / per_word, add(length < 4) / per_word
    pair = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ words.hash
    _, first, times = np.unique(pair, return_index=True, return_counts=True)
    out["distinct"] = np.bincount(owner[first], minlength=docs) / per_word
    out["top_word"] = np.zeros(docs)
    np.maximum.at(out["top_word"], owner[first], times)
    out["top_word"] /= per_word
    for name, step in (("repeat_next", 1), ("repeat_two", 2)):
        same = np.zeros(len(pair), bool)
        same[step:] = pair[step:] == pair[:-step]
        out[name] = add(same) / per_word
    initial = texts.data[words.start] if len(words.start) else np.zeros(0, np.uint8)
    out["capital_words"] = add(_KINDS["upper"][initial]) / per_word
    text = np.repeat(np.arange(docs), np.diff(texts.offsets))
    for name, kind in _KINDS.items():
        out[name] = np.bincount(text, kind[texts.data], docs) / size
    out["line_words"] = np.log1p(count / (1 + out["line_ends"] * size))
    full = np.stack([out[n] for n in NAMES], axis=1)
    full[count == 0] = 0
    return full


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=3 << 20):
        rows = statistics(Texts(batch.column("text"))).astype(np.float32)
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), values], ["doc_id", "held_out", "stats"])


class Model:
    """Standardisation, projection, ridge weights and the calibrated steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        # a kernel as wide as typical distances of standardised rows
        self.project = rng.standard_normal((len(mean), features)) / np.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps, self.values = np.zeros(1), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.project + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.values)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)


SUM = "row int, sums array<double>"


def _sum_batch(parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts.tolist(), pa.list_(pa.float64()))], ["row", "sums"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, len(NAMES)))
    for batch in batches:
        x = _rows(batch)
        total += np.stack([np.full(x.shape[1], len(x)), x.sum(axis=0), (x**2).sum(axis=0)])
    yield _sum_batch(total)


def _normal(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    size = len(model.weights)
    total = np.zeros((size, size + 1))
    for batch in batches:
        z, y = model.features(_rows(batch)), batch.column("quality").to_numpy().astype(np.float64)
        total += np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)
    yield _sum_batch(total)


def _grid(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    total = np.zeros((GRID + 1, 2))
    for batch in batches:
        place = np.round((np.clip(model.raw(_rows(batch)), -0.5, 1.5) + 0.5) / 2 * GRID).astype(np.int64)
        y = batch.column("quality").to_numpy().astype(np.float64)
        total += np.stack([np.bincount(place, minlength=GRID + 1), np.bincount(place, y, GRID + 1)], axis=1)
    yield _sum_batch(total)


def _add_rows(key: tuple, table: pa.Table) -> pa.Table:
    parts = table.column("sums").combine_chunks()
    total = parts.flatten().to_numpy().reshape(len(parts), -1).sum(axis=0)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["row", "sums"])


def _added(parts: DataFrame) -> np.ndarray:
    """The parts of all tasks, added row by row; a matrix of fixed size."""
    rows = parts.groupBy("row").applyInArrow(_add_rows, SUM).collect()
    return np.array([r.sums for r in sorted(rows, key=lambda r: r.row)])


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nondecreasing means of cells with rows."""
    blocks: list[list[float]] = []
    for n, s in zip(count, total):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, s2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + s2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / n) for n, s, k in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled rows of stats that are not held out. Null labels
    do not count; of several labels of an id the largest does. Without rows of
    both classes every score is the share of class 1 (0.5 without any)."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    rows = written(stats.filter("NOT held_out").join(known, "doc_id").select("stats", "quality"), "training")
    moments = _added(rows.mapInArrow(_moments, SUM))
    count = moments[0, 0] if len(moments) else 0
    if not count:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    mean = moments[1] / count
    scale = np.sqrt(np.maximum(moments[2] / count - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1))
    normal = _added(rows.mapInArrow(partial(_normal, model=model), SUM))
    model.weights = np.linalg.solve(normal[:, :-1] + RIDGE * np.eye(len(normal)), normal[:, -1])
    grid = _added(rows.mapInArrow(partial(_grid, model=model), SUM))
    has = grid[:, 0] > 0
    model.steps = (np.flatnonzero(has) / GRID) * 2 - 0.5
    # two rows of either class at the ends, so that no score is quite 0 or 1
    model.values = isotonic(grid[has, 0], grid[has, 1]) * count / (count + 2) + 1 / (count + 2)
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _score(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = model.score(_rows(batch)) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score_documents(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (4, 2), threshold: float = THRESHOLD) -> DataFrame:
    """Score of every row, 0 to 1. Null texts count as empty, whose statistics
    are all 0. Null ids are scored and not held out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), *held).alias("held_out"))
    stats = written(rows.mapInArrow(_statistics, "doc_id long, held_out boolean, stats array<float>"), "statistics")
    return stats.mapInArrow(partial(_score, model=fit(stats, labels), threshold=threshold), SCHEMA)
