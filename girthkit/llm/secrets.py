"""Secret scans: patterns, and a token-efficiency test for random strings.

A BPE vocabulary holds what is common in text, so ordinary words take few
tokens a character and random strings many. Runs of secret-like characters
whose characters per token under a tiktoken vocabulary fall below a ratio are
spans of kind `random`, after digests (hex of the length of a known digest)
and identifiers (UUIDs, numbers, words joined by separators) are set aside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import chunks

# The patterns of the base kinds, in their order, and the least
# length of the group that counts.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: The same hits as the hex pattern with its least length; runs too short are
#: skipped without a match of their own.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Hex lengths of CRC-64, MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = frozenset({16, 32, 40, 56, 64, 96, 128})
#: Characters a token below which a string counts as random.
RATIO = 2.0
LEAST = 16
_PART = re.compile(r"[A-Za-z0-9]+")
_WORD = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")


class RandomStrings:
    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def is_random(self, s: str, ratio: float) -> bool:
        """Whether a candidate is a random string and no digest or identifier."""
        if re.fullmatch(r"[0-9a-fA-F]+", s) and len(s) in DIGESTS or UUID.search(s) or s.isdigit():
            return False
        parts = [x for x in re.split(r"[^A-Za-z0-9]+", s) if x]
        # an identifier: each part letters of one case (or capitalised), or a number
        if all(re.fullmatch(r"[A-Z]?[a-z]+|[A-Z]+|(?:[A-Z][a-z]+)+|[a-z]+(?:[A-Z][a-z]+)+|\d{1,8}", x) for x in parts):
            return False
        classes = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        return classes >= 2 and len(s) < ratio * len(self.encoding.encode_ordinary(s))


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, group start) of the base kinds' matches."""
    out = []
    for kind, pattern, group, least in BASE:
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), kind, m.start(group)))
    return out


def _outside(start: int, end: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What known spans leave of start to end."""
    out = []
    for a, b in sorted(known):
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def random_parts(text: str, start: int, end: int, strings: RandomStrings, ratio: float, least: int) -> list[tuple[int, int]]:
    """The random spans of a run: the whole run, or else its parts between
    separators, and what stretches of `least` characters find in the rest,
    taken to whole parts, without readable words at their ends."""
    if end - start < least:
        return []
    if strings.is_random(text[start:end], ratio):
        return [(start, end)]
    parts = [m.span() for m in _PART.finditer(text, start, end)]
    out = [(a, b) for a, b in parts if b - a >= least and strings.is_random(text[a:b], ratio)]
    for a, b in _outside(start, end, out):
        hits: list[list[int]] = []
        for i in range(a, b - least + 1):
            if strings.is_random(text[i : i + least], ratio):
                if hits and i <= hits[-1][1]:
                    hits[-1][1] = i + least
                else:
                    hits.append([i, i + least])
        spans: list[tuple[int, int]] = []
        for x, y in hits:
            inside = [p for p in parts if p[0] < y and x < p[1]]
            while len(inside) > 1 and _WORD.fullmatch(text, *inside[0]) and inside[-1][1] - inside[1][0] >= least:
                inside.pop(0)
            while len(inside) > 1 and _WORD.fullmatch(text, *inside[-1]) and inside[-2][1] - inside[0][0] >= least:
                inside.pop()
            x, y = inside[0][0], inside[-1][1]
            if spans and x <= spans[-1][1]:
                before = spans.pop()
                x, y = before[0], max(y, before[1])
            spans.append((x, y))
        out += spans
    return sorted(out)


def scan(text: str, strings: RandomStrings, ratio: float = RATIO, least: int = LEAST) -> list[tuple[int, int, str]]:
    """All spans by start, then kind in the order of the kinds: the base kinds'
    and `random` ones of what these, UUIDs and digests leave of a run. Code
    points, end exclusive."""
    base = base_spans(text)
    taken = [(a, b) for a, b, *_ in base]
    more = []
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() >= least:
            known = [x for x in taken if x[0] < m.end() and m.start() < x[1]]
            known += [x.span() for x in UUID.finditer(text, m.start(), m.end())]
            known += [x.span() for x in _PART.finditer(text, m.start(), m.end()) if len(x.group()) in DIGESTS and re.fullmatch(r"[0-9a-fA-F]+", x.group())]
            more += [(a, b, "random") for x, y in _outside(m.start(), m.end(), known) for a, b in random_parts(text, x, y, strings, ratio, least)]
    rank = {"assign": 0, "access": 1, "hex": 2, "random": 3}
    return sorted([(a, b, k) for a, b, k, _ in base] + more, key=lambda x: (x[0], rank[x[2]]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with every span replaced by a mark of its kind; spans that overlap
    are replaced as one, by the kind of the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@lru_cache(1)
def _strings(path: str, pattern: str) -> RandomStrings:
    """One a Python worker: it outlives the tasks."""
    return RandomStrings(path, pattern)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def _scan(batches: Iterator[pa.RecordBatch], path: str, pattern: str, ratio: float) -> Iterator[pa.RecordBatch]:
    strings = _strings(path, pattern)
    for batch in chunks(batches):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            spans = scan(text or "", strings, ratio)
            printed = [f"{k}:{a}:{b}" for a, b, k in spans]
            base = ",".join(p for p, (_, _, k) in zip(printed, spans) if k != "random")
            number = {k: sum(x[2] == k for x in spans) for k in ("assign", "access", "hex", "random")}
            rows.append((doc, number["assign"], number["access"], number["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(printed), number["random"]))
        whole, text = pa.int64(), pa.string()
        types = [whole, whole, whole, whole, text, text, whole]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in SCHEMA.split(", ")])


def scan_documents(df: DataFrame, path: str, pattern: str, ratio: float = RATIO, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans and counts of every row; null texts count as empty, which have
    none. Texts are scanned whole; no shuffle."""
    small_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_scan, path=path, pattern=pattern, ratio=ratio), SCHEMA)


def _redact(batches: Iterator[pa.RecordBatch], path: str, pattern: str, ratio: float) -> Iterator[pa.RecordBatch]:
    strings = _strings(path, pattern)
    for batch in chunks(batches):
        texts = [t if t is None else redact(t, scan(t, strings, ratio)) for t in batch.column("text").to_pylist()]
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in batch.schema.names:
            old = batch.column("n_chars").to_pylist()
            new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, old)], pa.int64()).cast(batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)


def redact_documents(df: DataFrame, path: str, pattern: str, ratio: float = RATIO) -> DataFrame:
    """df with every span of its text column masked, and n_chars (if it has
    that column, in its type) counted again. Null texts stay null, with the
    n_chars they have. Rows and other columns stay."""
    small_batches(df.sparkSession)
    return df.mapInArrow(partial(_redact, path=path, pattern=pattern, ratio=ratio), df.schema)
