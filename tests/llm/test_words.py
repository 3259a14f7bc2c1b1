"""Words that collide under polynomial hashes are told apart everywhere."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from girthkit.llm import jaccard, katz, packing, pieces
from girthkit.llm.queries import vocabulary
from girthkit.llm.words import Cache, Texts, Words, distinct, hashes


def thue_morse(rounds):
    word = "a"
    for _ in range(rounds):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def twins(spark, tmp_path_factory):
    """Two words of 2048 letters, alone and among others; documents of ids 1 to 6."""
    one, other = thue_morse(11)
    texts = [one, other, f"{one} b c d e f", f"{other} b c d e f", f"x {other}", f"x {one}"]
    path = f"file://{tmp_path_factory.mktemp('twins')}/docs"
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path), dict(enumerate(texts, 1))


def test_distinct_goes_by_bytes():
    words = Words(Texts(pa.array(["aa bb aa", "c aa " + "d" * 70, "d" * 69 + "e " + "d" * 70])))
    for collide in (False, True):
        if collide:
            words.hash[:] = 7
        at, codes = distinct(words)
        assert [words.word(at[c]) for c in codes] == [words.word(i) for i in range(len(words.start))]
        assert len(at) == 5
        values, codes = Cache(lambda w: [x.upper() for x in w])(words)
        assert [values[c] for c in codes] == [words.word(i).upper() for i in range(len(words.start))]


def test_hashes_depend_on_bytes_only():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    start = np.sort(rng.integers(0, 3900, 3000))
    end = start + rng.integers(0, 100, 3000)
    by: dict = {}
    for a, b, h in zip(start, end, hashes(data, start, end)):
        assert by.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by.values())) == len(by)
    zeros = np.zeros(100, np.uint8)
    assert len(set(hashes(zeros, np.zeros(100, int), np.arange(100)).tolist())) == 100


def test_pieces(twins):
    import sentencepiece

    docs, texts = twins
    model = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: r for r in pieces.encode_digests(docs, model).collect()}
    for k, text in texts.items():
        ids = library.encode(text)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert {r.doc_id: r.ids for r in pieces.encode(docs, model).collect()} == {k: library.encode(t) for k, t in texts.items()}


def test_packing(twins):
    from tokenizers import Tokenizer

    docs, texts = twins
    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids_crc32 for r in packing.pieces(docs, path, 1 << 20).collect()}
    for k, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert got[k] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_katz_counts(twins):
    docs, texts = twins
    got = {r.doc_id: r for r in katz.katz_scores(docs, order=2).collect()}
    train = {k for k in texts if zlib.crc32(str(k).encode()) % 7 != 2}
    words = [w for k in train for w in [*texts[k].split(), None]]
    for k, text in texts.items():
        own = [*text.split(), None]
        base = sum(np.log10((words.count(w) + 1) / (len(words) + len(set(words)) + 1)) for w in own)
        assert got[k].n_known == sum(w in words for w in own)
        assert got[k].base_score == pytest.approx(base)


def test_jaccard(twins):
    docs, _ = twins
    got = {r.doc_id: r.component_id for r in jaccard.links(docs).collect()}
    assert got == {k: k for k in range(1, 7)}


def test_pieces_by_block(monkeypatch):
    """Blocks ask and are answered without an object a word; words that share
    a hash are told apart; all is as the library has it."""
    import pyspark
    import sentencepiece

    model = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["one two  three one", None, "", " ", "▁ a▁b ⁇ ﬁ é́ 😀", "two " * 50, "x" * 200, "one\ttwo\nthree two"]
    rows = [pa.record_batch([pa.array(range(a, a + 4)), pa.array(texts[a : a + 4], pa.string())], ["doc_id", "text"]) for a in (0, 4)]
    monkeypatch.setattr(pyspark, "TaskContext", type("T", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    monkeypatch.setattr(pieces, "BLOCK", 0)
    for collide in (False, True):
        if collide:
            monkeypatch.setattr("girthkit.llm.words.hashes", lambda data, start, end: np.full(len(start), 7, np.uint64))
        with monkeypatch.context() as m:
            if not collide:
                m.setattr(Words, "word", lambda *_: pytest.fail("an object a word"))
            asked = pa.Table.from_batches(pieces._ask(iter(rows), 2))
        parts = sorted(set(asked.column("part").to_pylist()))
        assert len(set(asked.column("block").to_pylist())) == 2 and (len(parts) > 1) != collide
        answers = pa.concat_tables(pieces._segment(asked.filter(pa.compute.equal(asked.column("part"), p)), model) for p in parts)
        monkeypatch.setattr(pieces, "rows_of", lambda table, block, columns: table.filter(pa.compute.equal(table.column("block"), block)).select(columns))
        got = [r for b in pieces._digests(iter(rows), answers, 2) for r in b.to_pylist()]
        ids = [r["ids"] for b in pieces._ids(iter(rows), answers, 2) for r in b.to_pylist()]
        assert [r["doc_id"] for r in got] == list(range(8)) and ids == [library.encode(t or "") for t in texts]
        for r, own in zip(got, ids):
            assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(own).encode()).hexdigest()
