"""Words of whole texts as numpy arrays, one bounded block of documents at a time.

A word is a run of bytes other than space and 0x09-0x0D of the UTF-8 text.
Everything here runs inside Spark tasks on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_RE = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
BLOCK_BYTES = 2 << 20          # text handled at once by one Python worker

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)              # odd multiplier of the word hash
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def fields(names) -> Column:
    """Columns of the input as one struct: they travel along under any names."""
    return F.struct(*[F.col("`" + n.replace("`", "``") + "`") for n in names]).alias("row")


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def blocks(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a block have ``max_bytes`` at most
    (a longer single text is a block of its own)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        off = _offsets(b.column(b.schema.get_field_index(text)))[0]
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def _offsets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and the bytes of a string array; null is the empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.fill_null("").cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], buf


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        out = []
        for base in (_P, _PINV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Word spans of a block of texts.

    ``buf``: bytes of all texts; ``offsets``: where each text starts (n + 1);
    ``start``/``end``: byte span of each word in ``buf``; ``doc``: text number
    of each word; ``first``: number of the first word of each text (n + 1).
    Nulls and texts without words have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.offsets, buf = _offsets(texts)
        self.buf = _LOWER[buf] if lower else buf
        n = len(self.buf)
        if n:
            word = ~_SPACE[self.buf]
            edge = np.zeros(n + 1, bool)
            edge[self.offsets[self.offsets < n]] = True
            edge[n] = True
            begins = word.copy()
            begins[1:] &= ~word[:-1] | edge[1:n]
            ends = word.copy()
            ends[:-1] &= ~word[1:] | edge[1:n]
            self.start = np.flatnonzero(begins)
            self.end = np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes (polynomial, then mixed)."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _tables(len(self.buf))
        c = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up, out=c[1:])
        h = (c[self.end] - c[self.start]) * down[self.start]
        return mix(h)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Positions where a new value begins in a sorted array."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
