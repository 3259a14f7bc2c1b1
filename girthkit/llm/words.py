"""Texts as numpy arrays: words and their 64-bit hashes straight from Arrow
buffers, and a bounded cache of what a tokenizer makes of a word."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in chunks of about this many bytes (one text at least).
CHUNK = 3 << 19

#: Bytes of a word that are worked on with all other words' in one go.
SHORT = 64

_SEED = np.uint64(0x9E3779B97F4A7C15)
_FRONT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: one-to-one, all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as an integer (zeros follow the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _block(eights: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8 k and on, eight at most, of words of more than 8 k bytes."""
    return eights[start + 8 * k] & _FRONT[np.minimum(size - 8 * k, 8)]


def unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the first place of each, and the place of each
    value among them. The sort need not be stable, which makes it faster."""
    order = np.argsort(values)
    found = values[order]
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    codes = np.empty(len(found), np.int64)
    codes[order] = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    return found[begins], np.minimum.reduceat(order, begins) if len(begins) else begins, codes


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    release()


class Texts:
    """The bytes of a column of texts (null: empty) and where each begins."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """Words between ASCII white space of all texts: start and end byte, hash
    (of the word with A-Z lowered, unless raw), and `first`, the place of each
    text's first word."""

    def __init__(self, texts: Texts, raw: bool = False, begins: np.ndarray | None = None, hashed: bool = True):
        data, n = texts.data, len(texts.data)
        self.texts = texts
        if begins is None:
            inside = ~_IS_SPACE[data]
            edge = np.zeros(n + 1, bool)
            edge[texts.offsets] = True
            edge = edge[:n]
            before = np.empty(n, bool)
            before[:1] = False
            before[1:] = inside[:-1]
            self.start = np.flatnonzero(inside & (edge | ~before))
            after = np.zeros(n, bool)
            after[:-1] = inside[1:] & ~edge[1:]
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = begins
            self.end = np.append(begins[1:], n) if n else begins
        self.first = np.searchsorted(self.start, texts.offsets)
        self.hash = np.zeros(0, np.uint64) if not hashed else hashes(data if raw else LOWER[data], self.start, self.end)

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.texts)), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.texts.data[self.start[i] : self.end[i]].tobytes()

    def listed(self, at: np.ndarray) -> list[bytes]:
        """The words at these places."""
        start, end = self.start[at], self.end[at]
        body, ends = joined(self.texts.data, start, end).tobytes(), np.cumsum(end - start).tolist()
        return [body[a:b] for a, b in zip([0, *ends], ends)]


def words_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Words:
    """The words data[start:end], raw and of no text."""
    out = object.__new__(Words)
    out.texts = object.__new__(Texts)
    out.texts.data, out.texts.offsets = data, np.zeros(1, np.int64)
    out.start, out.end, out.first = start, end, np.zeros(1, np.int64)
    out.hash = hashes(data, start, end)
    return out


def joined(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """values[start:end] of all pairs, one after the other."""
    size = end - start
    at = np.repeat(start - np.cumsum(size) + size, size)
    at += np.arange(len(at))
    return values[at]


def fronts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first eight bytes of data[start:end], as integers in their order."""
    return _block(_eights(data), start, end - start, 0).byteswap()


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair: a chain of finalisers
    over eight bytes at a time, for words beyond SHORT bytes a BLAKE2."""
    size, eights = end - start, _eights(data)
    out, live = mix(size.astype(np.uint64) + _SEED), np.arange(len(start))
    with np.errstate(over="ignore"):
        for k in range(SHORT // 8):
            live = live[size[live] > 8 * k]
            if not len(live):
                break
            out[live] = mix(out[live] * _SEED + _block(eights, start[live], size[live], k))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of `width` words; a text of fewer words has
    one, its whole sequence; a text without words has none."""
    counts = np.diff(words.first)
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(counts)), per)
    begin = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + words.first[:-1][owner]
    length = np.minimum(counts[owner], width)
    out = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            has = k < length
            at = np.where(has, begin + k, 0)
            word = words.hash[at] if len(words.hash) else np.zeros(0, np.uint64)
            out = np.where(has, mix(out * np.uint64(0x9FB21C651E98DF25) + word), out)
    return out, owner


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, data2: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether data[start:end] equals data2[start2:end2], for each row."""
    size, same = end - start, end - start == end2 - start2
    eights = _eights(data)
    eights2 = eights if data2 is data else _eights(data2)
    live = np.flatnonzero(same & (start != start2)) if data2 is data else np.flatnonzero(same)
    for k in range(SHORT // 8):
        live = live[size[live] > 8 * k]
        if not len(live):
            return same
        equal = _block(eights, start[live], size[live], k) == _block(eights2, start2[live], size[live], k)
        same[live[~equal]] = False
        live = live[equal]
    for i in live[size[live] > SHORT].tolist():
        same[i] = np.array_equal(data[start[i] : end[i]], data2[start2[i] : end2[i]])
    return same


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct word, the distinct word of each word), by
    bytes: words that only share a hash are told apart."""
    _, at, codes = unique(words.hash)
    odd = np.flatnonzero(~same_bytes(words.texts.data, words.start, words.end, words.texts.data, words.start[at][codes], words.end[at][codes])) if len(codes) else codes
    if len(odd):
        found: dict[bytes, int] = {}
        codes, more = codes.copy(), []
        for i in odd.tolist():
            if (k := found.setdefault(words.word(i), len(at) + len(more))) == len(at) + len(more):
                more.append(i)
            codes[i] = k
        at = np.append(at, more)
    return at, codes


class Cache:
    """What `encode` makes of distinct words, kept over the chunks and tasks of
    a Python worker. encode gets a list of words and returns a list of bytes.
    Holds at most `most` words, the first that come, which the frequent ones
    are among; others are encoded anew in each chunk."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int = 150_000):
        self.encode, self.most = encode, most
        # hashes in order, values, and the words' bytes with their places
        self.keys, self.values, self.store = np.zeros(0, np.uint64), np.zeros(0, object), np.zeros(0, np.uint8)
        self.start, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(value of each distinct word, the distinct word of each word)."""
        at, codes = distinct(words)
        keys, values = words.hash[at], np.empty(len(at), object)
        known = held = np.zeros(len(at), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            held = self.keys[place] == keys
            known = held & same_bytes(words.texts.data, words.start[at], words.end[at], self.store, self.start[place], self.end[place])
            values[known] = self.values[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = words.listed(at[new])
            made = self.encode(raw)
            values[new] = np.fromiter(made, object, len(made))
            # a hash is held once: what collides with a held word stays out
            free = np.flatnonzero(~held[new])
            free = free[np.unique(keys[new[free]], return_index=True)[1]][: max(0, self.most - len(self.keys))]
            sizes = np.array([len(raw[i]) for i in free.tolist()], np.int64)
            ends = len(self.store) + np.cumsum(sizes)
            order = np.argsort(both := np.concatenate([self.keys, keys[new[free]]]), kind="stable")
            self.keys, self.values = both[order], np.concatenate([self.values, values[new[free]]])[order]
            self.start, self.end = np.concatenate([self.start, ends - sizes])[order], np.concatenate([self.end, ends])[order]
            self.store = np.concatenate([self.store, np.frombuffer(b"".join([raw[i] for i in free.tolist()]), np.uint8)])
        return values, codes


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed differences, byte by byte plane."""
    import zstandard

    step = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    planes = step.view(np.uint8).reshape(-1, 8).T
    wide = max([1, *(k + 1 for k in range(8) if planes[k].any())]) if len(step) else 1
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:wide]).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    wide = blob[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(wide, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :wide] = flat.T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Any array, compressed by byte planes."""
    import zstandard

    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def stretch(blob: bytes, dtype: type) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(flat.T).view(dtype).ravel()
