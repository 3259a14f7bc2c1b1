"""Ids of many words encoded as one text against each word alone."""

import random

import numpy as np

from girthkit.llm.packing import WordIds
from girthkit.llm.queries import vocabulary

ODD = ["\x01", "a\x01", "\x01\x01b", "İx", "İ", "̈", "é", "́e", " ", "　a b", "\u0085", "</w>", "a</w>b", "<|endoftext|>", "x<|startoftext|>y", "it's", "'s", "12a", "ﬁ", "한", "ᄒ", "ᅡ", "日本", "😀", "a😀b", "ǅ", "ß&&&", "&", "​", "\x00", "\x7f", "Ⅷ", "ʰ", "̸", "=", "x" * 3000, "é" * 900]


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def alone(ids, words):
    return [np.array(ids.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]


def test_odd_words():
    ids, rng = WordIds(vocabulary("word_bpe_49k.json")), random.Random(5)
    want = dict(zip(ODD, alone(ids, ODD)))
    want |= dict(zip(plain := ["the", "einßter", "été", "a.b", "x!!", "ж"], alone(ids, plain)))
    assert ids([]) == []
    for w in want:
        assert ids([w.encode()]) == [want[w]]
    for size in (2, 3, 5, 20, 200, 5000):
        for _ in range(20):
            words = rng.choices(rng.choice([ODD, plain, plain + ODD[3:], plain + ODD]), k=size)
            assert ids([w.encode() for w in words]) == [want[w] for w in words]


def test_words_go_together():
    ids, rng = WordIds(vocabulary("word_bpe_49k.json")), random.Random(6)
    words = ["".join(rng.choices("abcdéж", k=9)) + rng.choice(["", "", "!!", "12"]) for _ in range(3000)]
    want = alone(ids, words)
    ids.tokenizer = Counted(ids.tokenizer)
    assert ids([w.encode() for w in words]) == want
    assert ids.tokenizer.texts <= 2
