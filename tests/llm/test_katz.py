"""Katz back-off of any order against a plain version, over many blocks."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from girthkit.llm import katz


class Plain:
    def __init__(self, sentences, order):
        self.grams = {n: Counter() for n in range(1, order + 1)}
        for own in sentences:
            for n in self.grams:
                # a start stands once before the first token
                self.grams[n].update(tuple((["<s>"] + own)[max(0, i + 2 - n) : i + 2]) if n > 1 else (w,) for i, w in enumerate(own))
        self.total = sum(self.grams[1].values())
        self.d = {n: katz.discounts([sum(v == r for v in g.values()) for r in range(1, 7)]) for n, g in self.grams.items()}
        left = sum(c - self.cut(1, c) for c in self.grams[1].values())
        self.bottom, self.unknown = (self.total, left / self.total) if left > 1e-12 else (self.total + 1, 1 / (self.total + 1))
        self.after = {n: defaultdict(dict) for n in self.grams}
        for n, g in self.grams.items():
            for gram, c in g.items():
                self.after[n][gram[:-1]][gram[-1]] = c

    def cut(self, n, c):
        return self.d[n][min(c, len(self.d[n]) - 1)] * c

    def p(self, context, w, n):
        if n == 1:
            return self.cut(1, self.grams[1][(w,)]) / self.bottom if (w,) in self.grams[1] else self.unknown
        context = context[-(n - 1) :]
        lower = lambda x: self.p(context, x, n - 1)
        seen = self.after[n].get(context)
        if not seen:
            return lower(w)
        c, gone = sum(seen.values()), sum(x - self.cut(n, x) for x in seen.values())
        b, g = (c, gone / c) if gone > 1e-12 else (c + 1, 1 / (c + 1))
        if w in seen:
            return self.cut(n, seen[w]) / b
        return g / max(1 - sum(map(lower, seen)), self.unknown) * lower(w)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_any_order(spark, tmp_path, order):
    rng = random.Random(order)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " \t", *texts[:30], "Rare " * 5 + "words", "THE end"]
    rows = [(i, t, "x", True) for i, t in enumerate(texts)] + [(5, "an id twice", "x", True), (None, "no id w1 w2", "x", False)]
    spark.createDataFrame(rows, "doc_id long, text string, block string, held_out boolean").repartition(7).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    tokens = [(i, (t or "").lower().split() + ["</s>"]) for i, t, *_ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = Plain([own for i, own in tokens if not held(i)], order)
    want = []
    for i, own in tokens:
        score = sum(math.log10(model.p(tuple(["<s>"] + own[:k]), w, order)) for k, w in enumerate(own))
        want.append((-1 if i is None else i, held(i), len(own), sum((w,) in model.grams[1] for w in own), model.total, score))
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in katz.katz_scores(docs, order=order).collect()]
    by = lambda r: (r[0], r[2])
    assert [r[:5] for r in sorted(got, key=by)] == [r[:5] for r in sorted(want, key=by)]
    assert [r[5] for r in sorted(got, key=by)] == pytest.approx([r[5] for r in sorted(want, key=by)], rel=1e-9)
    if order == 3:
        context, vocabulary = tuple(tokens[0][1][:2]), [g[0] for g in model.grams[1]]
        assert math.isclose(sum(model.p(context, w, 3) for w in vocabulary) + model.p(context, "never", 3), 1, rel_tol=1e-9)
