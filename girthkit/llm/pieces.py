"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary has a white-space marker after another character
(checked when the model is loaded), so no merge crosses the start of a run of
markers: a text is segmented exactly by segmenting each marked word (a run of
spaces and what follows up to the next space) by itself. Blocks of the scan
list their distinct marked words, dealt by hash range; a range segments each
distinct word of the corpus once with the library and tells every block what
its words became. Blocks then join ids and surfaces back by position. What
moves are the distinct words of each block, never the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import by_block, by_range, hash_bits, rows_of, same_scan
from .common import delete, fresh_path
from .words import Texts, Words, chunks, distinct, fronts, joined, squeeze, stretch, words_at

MARK = "▁"
#: Bytes of text whose distinct words make one question.
BLOCK = 8 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """Encodes marked words: the number of ids of each, the ids, and for each
    word that decoding them does not give back the surface that they decode to
    (else nothing)."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        for i in range(self.model.vocab_size()):
            if re.search(f"[^{MARK}]{MARK}", self.model.id_to_piece(i)):
                raise ValueError("a piece crosses a white-space marker; chunks can't be segmented alone")
        self.space = self.model.piece_to_id(MARK)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        parts = [self.some(words[a : a + 16384]) for a in range(0, len(words), 16384)] or [self.some([])]
        counts, ids, surfaces = zip(*parts)
        return np.concatenate(counts), np.concatenate(ids), list(chain.from_iterable(surfaces))

    def some(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        # the library puts a marker of its own before the text: it stands for
        # the word's first space
        ids = self.model.encode([w[1:].decode() for w in words], num_threads=1)
        ids = [x or [self.space] for x in ids]
        surfaces = [b" " + s.encode() for s in self.model.decode(ids)] if ids else []
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))
        return counts, flat, [b"" if s == w else s for s, w in zip(surfaces, words)]


@lru_cache(1)
def _pieces(model: str) -> Pieces:
    """One a Python worker: it outlives the tasks."""
    return Pieces(model)


def chunk_words(texts: Texts) -> tuple[Words, Texts]:
    """Marked words: each text gets the space that stands for the marker the
    library puts first; a literal marker counts as a space, as in the library."""
    rows = [texts.bytes(i) for i in range(len(texts))]
    mark = MARK.encode()
    rows = [b" " + (r.replace(mark, b" ") if mark in r else r) if r else b"" for r in rows]
    marked = Texts(pa.array([], pa.large_string()))
    marked.offsets = np.cumsum([0, *map(len, rows)])
    marked.data = np.frombuffer(b"".join(rows), np.uint8)
    space = marked.data == 0x20
    edge = np.zeros(len(marked.data) + 1, bool)
    edge[marked.offsets] = True
    before = np.empty(len(space), bool)
    before[:1] = False
    before[1:] = space[:-1]
    begins = np.flatnonzero(space & (edge[:-1] | ~before))
    return Words(marked, raw=True, begins=begins), marked


class Block:
    """Some texts of a scan: their words, the distinct ones by hash range and
    first bytes (the order of the question), and which of them is where."""

    def __init__(self, number: int, rows: list[pa.RecordBatch], bits: int):
        self.number, self.doc_id = number, pa.concat_arrays([r.column("doc_id") for r in rows])
        self.words, self.marked = words, marked = chunk_words(Texts(pa.concat_arrays([r.column("text") for r in rows])))
        at, codes = distinct(words)
        part = (words.hash[at] >> np.uint64(64 - bits)).astype(np.int64)
        order = np.lexsort((fronts(marked.data, words.start[at] + 1, words.end[at]), part))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.places, self.at = place[codes], at[order]
        self.cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1))

    def asked(self) -> list[tuple[int, int, bytes]]:
        start, end = self.words.start[self.at], self.words.end[self.at]
        return [(p, self.number, _listed(end[a:b] - start[a:b], joined(self.marked.data, start[a:b], end[a:b]))) for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])) if b > a]


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[Block]:
    from pyspark import TaskContext

    task, number, rows, held = TaskContext.get().partitionId(), 0, [], 0
    for batch in chunks(batches):
        rows.append(batch)
        held += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held > BLOCK:
            yield Block(task << 20 | number, rows, bits)
            rows, held, number = [], 0, number + 1
    if rows:
        yield Block(task << 20 | number, rows, bits)


def _listed(sizes: np.ndarray, body: np.ndarray | bytes) -> bytes:
    """Byte strings, one after the other, as one blob."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.int32(len(sizes)).tobytes() + sizes.astype(np.int32).tobytes() + bytes(body))


def _unlisted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, the byte strings one after the other)."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(data, np.int32, 1)[0])
    return np.frombuffer(data, np.int32, count, 4).astype(np.int64), np.frombuffer(data, np.uint8, offset=4 + 4 * count)


ASKED = "part int, block long, words binary"
ANSWER = "part int, block long, counts binary, ids binary, surfaces binary"


def _ask(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, bits):
        rows = block.asked()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["part", "block", "words"])


def _segment(table: pa.Table, model: str) -> pa.Table:
    """A range of the table: each distinct word is segmented once. An answer
    has the ids of a question's words and, for each, the surface that they
    decode to or nothing if it is the word."""
    sizes, bodies = zip(*(_unlisted(b) for b in table.column("words").to_pylist()))
    ends = np.cumsum(np.concatenate(sizes))
    words = words_at(np.concatenate(bodies), ends - np.concatenate(sizes), ends)
    at, codes = distinct(words)
    counts, ids, surfaces = _pieces(model)(words.listed(at))
    ends, answers = np.cumsum(counts), []
    for own in np.split(codes, np.cumsum([len(s) for s in sizes])[:-1]):
        odd = [surfaces[k] for k in own.tolist()]
        answers.append((squeeze(counts[own].astype(np.uint32)), squeeze(joined(ids, ends[own] - counts[own], ends[own])), _listed(np.fromiter(map(len, odd), np.int64, len(odd)), b"".join(odd))))
    columns = [pa.array(c, pa.binary()) for c in zip(*answers)]
    return pa.table([table.column("part"), table.column("block"), *columns], ["part", "block", "counts", "ids", "surfaces"])


def _answered(batches: Iterator[pa.RecordBatch], table: str, bits: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Blocks with what the table has for their distinct words: numbers of ids,
    the ids, sizes of surfaces, the surfaces."""
    for block in _blocks(batches, bits):
        rows = rows_of(table, block.number, ["part", "counts", "ids", "surfaces"]).sort_by("part").to_pylist() if len(block.at) else []
        counts = np.concatenate([np.zeros(0, np.int64), *(stretch(r["counts"], np.uint32).astype(np.int64) for r in rows)])
        ids = np.concatenate([np.zeros(0, np.uint32), *(stretch(r["ids"], np.uint32) for r in rows)])
        odd = [_unlisted(r["surfaces"]) for r in rows]
        sizes = np.concatenate([np.zeros(0, np.int64), *(s for s, _ in odd)])
        if not len(counts) == len(sizes) == len(block.at):
            raise RuntimeError("the texts came in another order than before; write them to a table first")
        yield block, counts, ids, sizes, b"".join(s.tobytes() for _, s in odd)


def _digests(batches: Iterator[pa.RecordBatch], table: str, bits: int) -> Iterator[pa.RecordBatch]:
    for block, counts, own, sizes, surfaces in _answered(batches, table, bits):
        digits = [b",%d" % i for i in range(int(own.max()) + 1 if len(own) else 0)]
        flat = b"".join(map(digits.__getitem__, own.tolist()))
        width = np.concatenate([[0], np.cumsum(np.fromiter(map(len, digits), np.int64, len(digits))[own])])
        ends = width[np.cumsum(counts)].tolist()
        printed = [flat[a:b] for a, b in zip([0, *ends], ends)]
        surface_ends, words, data = np.cumsum(sizes), block.words, block.marked.data
        whole, oddly = (np.concatenate([[0], np.cumsum(x[block.places])]) for x in (counts, sizes > 0))
        first, offsets, ids, decoded = words.first.tolist(), block.marked.offsets.tolist(), [], []
        for i, (a, b) in enumerate(zip(first, first[1:])):
            places = block.places[a:b].tolist()
            ids.append(hashlib.sha256(memoryview(b"".join(map(printed.__getitem__, places)))[1:]).hexdigest())
            text = data[offsets[i] + 1 : max(offsets[i] + 1, offsets[i + 1])]
            if oddly[b] > oddly[a]:
                text = b"".join(surfaces[surface_ends[c] - sizes[c] : surface_ends[c]] or words.word(k) for k, c in zip(range(a, b), places))[1:]
            decoded.append(hashlib.sha256(text).hexdigest())
        numbers = np.diff(whole[words.first])
        yield pa.RecordBatch.from_arrays([block.doc_id.cast(pa.int64()), pa.array(numbers, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(batches: Iterator[pa.RecordBatch], table: str, bits: int) -> Iterator[pa.RecordBatch]:
    for block, counts, own, _, _ in _answered(batches, table, bits):
        ends = np.cumsum(counts)
        ids = joined(own, (ends - counts)[block.places], ends[block.places])
        whole = np.concatenate([[0], np.cumsum(counts[block.places])])[block.words.first]
        lists = pa.ListArray.from_arrays(pa.array(whole, pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([block.doc_id.cast(pa.int64()), lists], ["doc_id", "ids"])


def _by_table(df: DataFrame, model: str, key: str, text: str, join: Callable, schema: str) -> DataFrame:
    spark = df.sparkSession
    with same_scan(spark):
        docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        bits = hash_bits(docs)
        asked = by_range(docs.mapInArrow(partial(_ask, bits=bits), ASKED), bits)
        table = by_block(asked.groupBy("part").applyInArrow(lambda rows: _segment(rows, model), ANSWER), docs, "pieces")
        path = fresh_path(spark, "encoded")
        docs.mapInArrow(partial(join, table=table, bits=bits), schema).write.parquet(path)
    delete(spark, table)
    return spark.read.schema(schema).parquet(path)


def encode_digests(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the number of ids, and SHA-256s of the ids and of what they
    decode to. Null texts count as empty (no ids); null and repeated keys are
    rows of their own; an empty table gives no rows. df is a table (read from
    files): its rows must come in the same order in every pass, which is
    checked."""
    return _by_table(df, model, key, text, _digests, SCHEMA)


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the ids as the library gives them; rows as encode_digests has them."""
    return _by_table(df, model, key, text, _ids, "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for batch in batches:
        ids = [x or [] for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(library.decode(ids) if ids else [], pa.string())], ["doc_id", "text"])


def decode(df: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give the empty text."""
    return df.select("doc_id", "ids").mapInArrow(partial(_decode, model=model), "doc_id long, text string")
