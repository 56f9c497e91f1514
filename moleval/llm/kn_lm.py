"""Interpolated modified Kneser-Ney language model: counted in Spark, stored as
sorted arrays of word numbers, memory-mapped by the workers that score.

Words are lower-cased (A-Z) and a text ends with an end token; words are 64-bit
hashes.  A first pass counts them and gives each a number, frequent words small
ones.  N-grams are numbers from then on.  Counting runs from the highest order
down: n-grams are combined inside tasks, packed as sorted numbers, shuffled by
their context's key range, merged, and written as one shard per range: n-grams in
order of (context key, last word), of the key only the bits that a directory
does not give, of the word the bytes that the vocabulary needs.  A context's key
is its numbers scattered one to one over their bits (a 64-bit hash where they
need more than 64).  A count is stored beside the key's bits in one number, those
that do not fit in a list beside it; the totals that discounts need are added up
from the counts of a context, those of contexts with many n-grams are stored.
Each distinct n-gram
then passes one count to its suffix, which makes the continuation counts of the
order below.  N-grams that begin a text keep their plain counts in lower orders.
Shards lie in the shared checkpoint folder; equal input gives equal files, so a
repeated task replaces a shard with itself.

Texts are scored by many at once: their n-grams are made distinct, put in the
order of the keys and looked up in several shards together, whose arrays alone are
read one by one.  Every shard stays open in a worker.

A ``file:`` folder is mapped in place; from another store a worker reads the
shards it needs.  The model grows with the corpus and nothing of it passes the
driver but one row of sums per shard.

Null and empty texts are the end token alone; repeated rows count as often as
they occur; without learning rows every word has the same probability; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from moleval.llm.words import Words, blocks, mix, run_starts
from moleval.session import checkpoint_dir

ORDER = 3
SHARD_CHARS = 12_000_000        # characters of learning text aimed at for one shard
FLUSH_TOKENS = 1_500_000        # tokens combined in a task before they are sent on
SCORE_TOKENS = 800_000          # tokens looked up at once
ASKED = 32                      # words asked for after a context beyond which its words are searched as one array
BUCKET = 4                      # n-grams of a shard for one entry of its directory, at least
WIDE = 64                       # n-grams of a context beyond which its totals are stored
STEPS = 4                       # n-grams of a context that are walked along
MOST_LOW = 56                   # bits of a key that fit a stored number beside a count, at most
GROUP = 1 << 16                 # n-grams looked up together, at least, where shards are asked for fewer each
TEXT_BYTES = 1 << 18            # text made into tokens at once: what a processor's cache holds

BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0xE6546B64A5A5A5A5)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHARDS = "kind int, shard int, data binary"


def token_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of begin mark, words and end mark of each text in a row; the
    position of each in its text (begin mark 0); tokens per text without the begin mark."""
    w = Words(texts, lower=True)
    n = w.counts + 1
    first = np.cumsum(n + 1) - (n + 1)
    out = np.full(len(w) + 2 * len(n), BEGIN, np.uint64)
    out[np.arange(len(w)) + 2 * w.doc + 1] = w.hashes()
    out[first + n] = END
    return out, np.arange(len(out)) - np.repeat(first, n + 1), n


def _joined(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Numbers of ``bits`` bits side by side in one."""
    out = columns[0]
    for c in columns[1:]:
        out = out << np.uint64(bits) | c
    return out


def _scatter(x: np.ndarray, width: int) -> np.ndarray:
    """One-to-one map of numbers of ``width`` bits that spreads them over the range."""
    mask, half = np.uint64((1 << width) - 1), np.uint64(max(1, width // 2))
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15):
        x = (x ^ (x >> half)) * np.uint64(odd) & mask
    return x ^ (x >> half)


def key_width(n: int, bits: int) -> int:
    """Bits of the key of a context of ``n`` words."""
    return min(n * bits, 64)


def _unscatter(x: np.ndarray, width: int) -> np.ndarray:
    """The numbers that ``_scatter`` was given."""
    mask, half = np.uint64((1 << width) - 1), max(1, width // 2)

    def unfold(x: np.ndarray) -> np.ndarray:
        out = x
        for _ in range(-(-width // half)):
            out = x ^ (out >> np.uint64(half))
        return out

    for odd in (0x9E3779B97F4A7C15, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9):
        x = unfold(x) * np.uint64(pow(odd, -1, 1 << 64)) & mask
    return unfold(x)


def context_key(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Key of a context of word numbers: its own up to 64 bits, a hash beyond."""
    if len(columns) * bits <= 64:
        return _scatter(_joined(columns, bits), len(columns) * bits)
    h = np.full(len(columns[0]), len(columns) + 1, np.uint64)
    for c in columns:
        h = mix(h * _STEP + c)
    return h


def _of_key(key: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    """The ``n`` word numbers of keys that are not hashes."""
    x = _unscatter(key, n * bits)
    return [x >> np.uint64(bits * i) & _ones(bits) for i in range(n - 1, -1, -1)]


def shard_of(key: np.ndarray, width: int, shards: int) -> np.ndarray:
    """Number of the range of a key of ``width`` bits; ranges follow the order of the keys."""
    top = min(width, 32)
    return ((key >> np.uint64(width - top)) * np.uint64(shards) >> np.uint64(top)).astype(np.int64)


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Numbers in as many bytes as the largest needs, first bytes together, then the second and so on."""
    width = -(-int(values.max(initial=0)).bit_length() // 8)
    return width, np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _pack(columns: list[np.ndarray], counts: np.ndarray) -> list[bytes]:
    """Rows of numbers with counts: the first column's first value and gaps, the other columns, and counts less 1."""
    first = columns[0][0]
    gaps = np.diff(columns[0], prepend=first)           # modulo 2^64, so the rows may be in any order
    widths, planes = zip(*[_planes(c) for c in (gaps, *columns[1:], counts.astype(np.uint64) - np.uint64(1))], strict=True)
    return [np.array([len(widths), len(counts), first, *widths], "<u8").tobytes() + pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)]


def _unpack(data: bytes) -> list[np.ndarray]:
    k, n, first = (int(v) for v in np.frombuffer(data, "<u8", 3))
    widths = [int(v) for v in np.frombuffer(data, "<u8", k, 24)]
    body = np.frombuffer(pa.Codec("zstd").decompress(data[24 + 8 * k:], n * sum(widths)), np.uint8) if any(widths) else np.zeros(0, np.uint8)
    out, at = [], 0
    for width in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = body[at:at + n * width].reshape(width, n).T
        out.append(full.view("<u8").reshape(-1))
        at += n * width
    return [np.cumsum(out[0], dtype=np.uint64) + np.uint64(first), *out[1:-1], (out[-1] + np.uint64(1)).astype(np.int64)]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns and counts of all packed rows, one piece after the other."""
    parts = [_unpack(d) for b in batches for d in b.column(b.schema.get_field_index("data")).to_pylist()]
    *columns, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
    return columns, counts


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the keys, equal ones in their own order, and the keys in it.
    A key's place is sorted with its leading bits, in one number: that is several times
    as fast as to sort places.  What the other bits change is little work for a merge sort."""
    if not len(key):
        return np.zeros(0, np.int64), key
    low, bits = key.min(), len(key).bit_length()
    shift = np.uint64(max(0, int(key.max() - low).bit_length() + bits - 64))
    order = (np.sort((key - low) >> shift << np.uint64(bits) | np.arange(len(key), dtype=np.uint64)) & _ones(bits)).astype(np.int64)
    key = key[order]
    if shift and (key[1:] < key[:-1]).any():
        more = np.argsort(key, kind="stable")
        order, key = order[more], key[more]
    return order, key


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array, as marks."""
    new = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return new


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place in them of each."""
    order, key = _numbered(key)
    new = _starts(key)
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(new, dtype=np.uint64) - np.uint64(1)
    return key[new], rank


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of hashes that occur often."""
    d = pa.array(x).dictionary_encode()
    values, rank = _ranks(d.dictionary.to_numpy())
    return values, rank[d.indices.to_numpy()]


def _one_key(keys: list[np.ndarray], widths: list[int], free: int) -> np.ndarray:
    """Numbers that order rows as the keys (of so many bits) do, with ``free`` bits left if ranks in place of keys make room."""
    out, width = keys[0], widths[0]
    for key, more in zip(keys[1:], widths[1:], strict=True):
        if width + more + free > 64:
            values, out = _ranks(out)
            width = len(values).bit_length()
        if width + more + free > 64:
            values, key = _ranks(key)
            more = len(values).bit_length()
        out, width = out << np.uint64(more) | key, width + more
    return out


def _distinct(keys: list[np.ndarray], widths: list[int], counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct rows of the keys (of so many bits) in their order, and the rows' summed counts (1 each if None)."""
    n = len(keys[0])
    order, key = _numbered(_one_key(keys, widths, n.bit_length()))
    at = np.flatnonzero(_starts(key))
    total = np.diff(at, append=n) if counts is None else np.add.reduceat(counts[order], at) if n else counts
    return order[at], total


def _grams(columns: list[np.ndarray], bits: int, counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order, and their summed counts."""
    k = len(columns)
    if counts is None and k * bits <= 64:       # sorted without their places
        x = np.sort(_joined(columns, bits))
        at = np.flatnonzero(_starts(x))
        x = x[at]
        return [x >> np.uint64(bits * i) & _ones(bits) for i in range(k - 1, -1, -1)], np.diff(at, append=len(columns[0]))
    at, counts = _distinct(columns, [bits] * k, counts)
    return [c[at] for c in columns], counts


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _rows(kind: int, columns: list[np.ndarray], counts: np.ndarray | None, bits: int, shards: int, number: np.ndarray | None = None) -> list[tuple]:
    """Distinct n-grams with their summed counts, packed by shard: that of a word is in
    its number, others go by their context's key, which stands for the context where it
    is no hash.  ``number``: the words' numbers, rising, where columns have places in it."""
    columns, counts = _grams(columns, bits if number is None else len(number).bit_length(), counts)
    if kind == 1:
        (word,) = columns if number is None else [number[columns[0]]]
        order, s = _numbered((word - np.uint64(1)) % np.uint64(shards))
        columns, counts, s = [word[order]], counts[order], s.astype(np.int64)
    else:
        new = np.zeros(len(counts), bool)
        new[:1] = True
        for c in columns[:-1]:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        key = context_key([c[first] if number is None else number[c[first]] for c in columns[:-1]], bits)
        size = np.diff(first, append=len(counts))
        order, key = _numbered(key)
        size = size[order]
        at = _spans(first[order], size)
        s = np.repeat(shard_of(key, key_width(kind - 1, bits), shards), size)
        sent = columns[-1:] if (kind - 1) * bits <= 64 else columns
        columns, counts = [np.repeat(key, size), *[c[at] if number is None else number[c[at]] for c in sent]], counts[at]
    edge = np.append(np.flatnonzero(_starts(s)), len(s))
    return [(kind, int(s[a]), d) for a, b in zip(edge.tolist(), edge[1:].tolist()) for d in _pack([c[a:b] for c in columns], counts[a:b])]


def _by_shard(s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shard numbers, each with the places that have it, in their order."""
    order = np.argsort(s.astype(np.uint16) if len(s) and s.max() < 1 << 16 else s, kind="stable")
    at = np.concatenate((run_starts(s[order]), [len(s)])).astype(np.int64)
    for a, b in zip(at, at[1:]):
        yield int(s[order[a]]), order[a:b]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], "int32"), pa.array(cols[1], "int32"), pa.array(cols[2], "binary")], ["kind", "shard", "data"])


class Store:
    """Arrays in a shared folder, by name."""

    def __init__(self, uri: str):
        self.uri = uri

    def _place(self) -> tuple[pafs.FileSystem, str]:
        if "://" not in self.uri and not self.uri.startswith("file:"):
            return pafs.LocalFileSystem(), self.uri
        if self.uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + self.uri.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(self.uri)

    def write(self, name: str, array: np.ndarray) -> None:
        fs, path = self._place()
        fs.create_dir(path, recursive=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(np.ascontiguousarray(array).data)
        fs.move(part, f"{path}/{name}")

    def write_counts(self, name: str, counts: np.ndarray) -> None:
        """Counts in a byte each; 255 stands for one in ``.more``, pairs (place, count)."""
        flat = np.ascontiguousarray(counts).reshape(-1)
        more = np.flatnonzero(flat >= 255)
        self.write(f"{name}.more", np.stack([more, flat[more]], 1).astype("<u8"))
        self.write(f"{name}.value", np.minimum(flat, 255).astype(np.uint8))

    def read(self, name: str, dtype, width: int = 1) -> np.ndarray:
        fs, path = self._place()
        path = f"{path}/{name}"
        if isinstance(fs, pafs.LocalFileSystem):
            # a process may hold 65,530 maps, and a model has more small files than that
            a = np.asarray(np.memmap(path, dtype, "r")) if os.path.getsize(path) > 1 << 16 else np.fromfile(path, dtype)
        else:
            with fs.open_input_file(path) as f:
                a = np.frombuffer(f.read(), dtype)
        return a.reshape(-1, width) if width > 1 else a


@lru_cache(1 << 16)             # all files of a model: each batch of texts asks for all of them in turn
def _shard(uri: str, name: str, dtype: str, width: int) -> np.ndarray:
    return Store(uri).read(name, dtype, width)


def _counts(uri: str, name: str, width: int, at: np.ndarray) -> np.ndarray:
    """Stored counts at the given places (rows of ``width``)."""
    out = _shard(uri, f"{name}.value", "u1", width)[at].astype(np.uint64)
    large = np.nonzero(out == 255)
    if len(large[0]):
        more = _shard(uri, f"{name}.more", "<u8", 2)
        place = at[large[0]] * width + (large[1] if width > 1 else 0)
        out[large] = more[np.searchsorted(more[:, 0], place.astype(np.uint64)), 1]
    return out


def _ones(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _sizes(width: int) -> list[int]:
    """The sizes of the aligned numbers that ``width`` bytes are stored in."""
    return [size for size in (8, 4, 2, 1) if width & size]


def _file_of(columns: list[np.ndarray], widths: list[int]) -> np.ndarray:
    """Columns of numbers of so many bytes, in parts of 8, 4, 2 and 1 bytes, the larger parts first."""
    parts = [(size, (c >> np.uint64(8 * (w & -2 * size))).astype(f"<u{size}")) for c, w in zip(columns, widths, strict=True) for size in _sizes(w)]
    return np.concatenate([part.view(np.uint8) for _, part in sorted(parts, key=lambda x: -x[0])])


def _columns_of(file: np.ndarray, widths: list[int]) -> list[list[np.ndarray]]:
    """The parts of each column of such a file."""
    n, at = len(file) // sum(widths), 0
    out: list[list[np.ndarray]] = [[] for _ in widths]
    for size, c in sorted(((size, c) for c, w in enumerate(widths) for size in _sizes(w)), key=lambda x: -x[0]):
        out[c].append(file[at:at + n * size].view(f"<u{size}"))
        at += n * size
    return out


def _first_from(value: Callable, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """First place between ``low`` and ``high`` (else ``high``) whose value, rising there, is
    not below ``least``.  ``value``: of a place for each, or for each of the given ones."""
    for _ in range(3):      # most spans are short: all are halved, then those left
        middle = (low + high) >> 1
        below = value(middle, None) < least
        below &= low < high
        low, high = np.where(below, middle + 1, low), np.where(below, high, middle)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        a, b = low[open_], high[open_]
        middle = (a + b) >> 1
        below = value(middle, open_) < least[open_]
        a, b = np.where(below, middle + 1, a), np.where(below, b, middle)
        low[open_], high[open_] = a, b
        open_ = open_[a < b]
    return low


def _write_shard(store: Store, name: str, key: np.ndarray, word: np.ndarray, counts: np.ndarray, bits: int) -> None:
    """N-grams in order of (context key, last word).  ``.head``: how many low bits
    of the key rows have, and the first of the numbers that its other bits make;
    ``.directory``: where the rows of each number begin; ``.key``: these low bits with
    the count in one number, then the words; ``.more``: counts that do not fit there."""
    span = (int(key[-1]) ^ int(key[0])).bit_length()
    low = next(low for low in range(span + 1) if low == MOST_LOW or (int(key[-1]) >> low) - (int(key[0]) >> low) <= len(key) // BUCKET)
    head = key >> np.uint64(low)
    starts = np.searchsorted(head, head[0] + np.arange(int(head[-1]) - int(head[0]) + 2, dtype=np.uint64))
    store.write(f"{name}.head", np.array([low, head[0]], "<u8"))
    store.write(f"{name}.directory", starts.astype("<u4" if len(key) < 1 << 32 else "<u8"))
    at = run_starts(key)
    size = np.diff(at, append=len(key))
    wide = size > WIDE
    totals = [np.add.reduceat(v, at)[wide] for v in (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64))]
    store.write(f"{name}.wide", np.stack([at[wide], *totals], 1).astype("<u8"))
    entry = _entry_bytes(low)
    most = (1 << 8 * entry - low) - 1
    more = np.flatnonzero(counts >= most)
    store.write(f"{name}.more", np.stack([more, counts[more]], 1).astype("<u8"))
    entries = (key & _ones(low)) << np.uint64(8 * entry - low) | np.minimum(counts, most).astype(np.uint64)
    store.write(f"{name}.key", _file_of([entries, word], [entry, -(-bits // 8)]))


def _entry_bytes(low: int) -> int:
    """Bytes of the number that has so many bits of a key and a count of 8 bits at least."""
    return next(size for size in (1, 2, 4, 8) if 8 * size >= low + 8)


@lru_cache(1 << 14)
def _gram_shard(uri: str, name: str, bits: int) -> "Grams":
    low, least = (int(v) for v in _shard(uri, f"{name}.head", "<u8", 1))
    entry = _entry_bytes(low)
    (entries,), words = _columns_of(_shard(uri, f"{name}.key", "u1", 1), [entry, -(-bits // 8)])
    starts = _shard(uri, f"{name}.directory", "<u4" if len(entries) < 1 << 32 else "<u8", 1)
    return Grams(low, least, starts, entries, 8 * entry - low, words, _shard(uri, f"{name}.wide", "<u8", 4), _shard(uri, f"{name}.more", "<u8", 2))


@dataclass(frozen=True)
class Grams:
    """A shard of n-grams as ``_write_shard`` stores them."""
    low: int
    least: int
    starts: np.ndarray
    entries: np.ndarray         # low bits of the key, then the count
    count_bits: int
    words: list[np.ndarray]
    wide: np.ndarray
    more: np.ndarray

    def counts(self, at: np.ndarray) -> np.ndarray:
        most = (1 << self.count_bits) - 1
        out = (self.entries.take(at) & self.entries.dtype.type(most)).astype(np.int64)
        large = np.flatnonzero(out == most)
        out[large] = self.more[np.searchsorted(self.more[:, 0], at[large].astype(np.uint64)), 1]
        return out


def _gather(arrays: list[np.ndarray], edges: np.ndarray, at: np.ndarray, dtype=np.uint64) -> np.ndarray:
    """Values at places of several arrays: those from an edge to the next are of one array."""
    out, edges = np.empty(len(at), dtype), edges.tolist()
    for array, lo, hi in zip(arrays, edges, edges[1:]):
        if lo < hi:
            out[lo:hi] = array.take(at[lo:hi], mode="clip")
    return out


class Shards:
    """Shards asked together, so that many small ones cost little more than one.  Whatever
    is asked is in their order; ``edges`` tell where each shard's begins."""

    def __init__(self, shards: list[Grams]):
        self.shards = shards
        self.starts, self.entries = [g.starts for g in shards], [g.entries for g in shards]
        self.words = list(zip(*[g.words for g in shards], strict=True))
        self.count_bits = np.array([g.count_bits for g in shards], np.uint64)

    def counts(self, edges: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, edges = np.empty(len(at), np.int64), edges.tolist()
        for g, lo, hi in zip(self.shards, edges, edges[1:]):
            if lo < hi:
                out[lo:hi] = g.counts(at[lo:hi])
        return out

    def word(self, edges: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, shift = np.zeros(len(at), np.uint64), 0
        for parts in self.words:
            out |= _gather(parts, edges, at) << np.uint64(shift)
            shift += 8 * parts[0].itemsize
        return out

    def _tails(self, edges: np.ndarray, shift: np.ndarray) -> Callable:
        def tails(at: np.ndarray, some: np.ndarray | None) -> np.ndarray:
            if some is None:
                return _gather(self.entries, edges, at) >> shift
            return _gather(self.entries, np.searchsorted(some, edges), at) >> shift[some]

        return tails

    def find(self, edges: np.ndarray, key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of n-grams, and four rows of their contexts' stats, for rising keys of contexts and the last words."""
        count, stats = np.zeros(len(key), np.int64), np.zeros((4, len(key)), np.int64)
        each = np.diff(edges)
        low, least, heads = (np.repeat(np.array(v, np.uint64), each) for v in zip(*[(g.low, g.least, len(g.starts) - 1) for g in self.shards], strict=True))
        head = (key >> low) - least
        at = np.flatnonzero(head < heads)       # below the first one the difference is huge
        edges, head = np.searchsorted(at, edges), head[at].astype(np.int64)
        a, b = _gather(self.starts, edges, head, np.int64), _gather(self.starts, edges, head + 1, np.int64)
        if not low.any():
            seen = np.flatnonzero(a < b)
            self._find_in_runs(np.searchsorted(seen, edges), at[seen], a[seen], b[seen], word, count, stats)
            return count, stats
        shift = np.repeat(self.count_bits, np.diff(edges))
        tail = key[at] & ((np.uint64(1) << low[at]) - np.uint64(1))
        tails = self._tails(edges, shift)
        a = _first_from(tails, a, b, tail)
        seen = np.flatnonzero((a < b) & (tails(a, None) == tail))
        edges, at, a, b, tail, shift = np.searchsorted(seen, edges), at[seen], a[seen], b[seen], tail[seen], shift[seen]
        # contexts of few n-grams, which most are, are walked along
        most, left = (np.uint64(1) << shift) - np.uint64(1), np.arange(len(at))
        hit, sums, long = np.zeros(len(at), np.int64), np.zeros((4, len(at)), np.int64), []
        for step in range(STEPS + 1):
            place = a[left] + step
            entry = _gather(self.entries, np.searchsorted(left, edges), place)
            if step:
                same = np.flatnonzero((entry >> shift[left] == tail[left]) & (place < b[left]))
                left, place, entry = left[same], place[same], entry[same]
            c = entry & most[left]
            far = (c == most[left]) | (step == STEPS)
            if far.any():
                long.append(left[far])
                left, place, c = left[~far], place[~far], c[~far]
            if not len(left):
                break
            c = c.astype(np.int64)
            for total, v in zip(sums, (c, c == 1, c == 2, c > 2), strict=True):
                total[left] += v
            mine = np.flatnonzero(self.word(np.searchsorted(left, edges), place) == word[at[left]])
            hit[left[mine]] = c[mine]
        count[at], stats[:, at] = hit, sums
        if long and len(long := np.sort(np.concatenate(long))):
            self._find_in_runs(np.searchsorted(long, edges), at[long], a[long], b[long], word, count, stats, tail[long], shift[long])
        return count, stats

    def _find_in_runs(self, edges: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, word: np.ndarray, count: np.ndarray, stats: np.ndarray,
                      tail: np.ndarray | None = None, shift: np.ndarray | None = None) -> None:
        """Set count and stats at ``at``, whose contexts begin at ``a`` and end at ``b`` or, where there is a ``tail``, before."""
        if not len(at):
            return
        before = np.cumsum([0, *map(len, self.entries[:-1])])
        first = run_starts(a + np.repeat(before, np.diff(edges)))
        asked = np.diff(first, append=len(a))
        contexts, a, b = np.searchsorted(first, edges), a[first], b[first]
        if tail is not None:
            b = _first_from(self._tails(contexts, shift[first]), a + 1, b, tail[first] + np.uint64(1))
        size, sums = b - a, np.zeros((4, len(a)), np.int64)
        few, many = np.flatnonzero(size <= WIDE), np.flatnonzero(size > WIDE)
        if len(few):
            begin = np.cumsum(size[few]) - size[few]
            v = self.counts(np.append(begin, size[few].sum())[np.searchsorted(few, contexts)], _spans(a[few], size[few]))
            for i, x in enumerate((v, v == 1, v == 2)):
                sums[i, few] = np.add.reduceat(x, begin, dtype=np.int64)
        edge = np.searchsorted(many, contexts).tolist()
        for g, lo, hi in zip(self.shards, edge, edge[1:]):
            if lo < hi:
                pick = many[lo:hi]
                sums[:3, pick] = g.wide[np.searchsorted(g.wide[:, 0], a[pick].astype(np.uint64)), 1:].T
        sums[3] = size - sums[1] - sums[2]
        stats[:, at] = np.repeat(sums, asked, axis=1)
        word = word[at]
        place = self._words_from(edges, contexts, a, b, asked, word)
        hit = np.flatnonzero((place < np.repeat(b, asked)) & (self.word(edges, place) == word))
        count[at] = 0
        count[at[hit]] = self.counts(np.searchsorted(hit, edges), place[hit])

    def _words_from(self, edges: np.ndarray, contexts: np.ndarray, low: np.ndarray, high: np.ndarray, asked: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First places from ``low`` to ``high`` whose word is not below ``least``, for contexts (``contexts``:
        their edges) after which so many are ``asked`` each; a context after which many are is read whole."""
        out, end = np.empty(len(least), np.int64), np.cumsum(asked)
        many = (asked > ASKED) & (high - low > ASKED) & (high - low < 256 * asked)
        at = np.flatnonzero(many)
        for i, s in zip(at.tolist(), (np.searchsorted(contexts, at, "right") - 1).tolist()):
            a, b, to, shift = low[i], high[i], end[i], 0
            whole = np.zeros(b - a, np.uint64)
            for parts in self.words:
                whole |= parts[s][a:b].astype(np.uint64) << np.uint64(shift)
                shift += 8 * parts[s].itemsize
            out[to - asked[i]:to] = a + np.searchsorted(whole, least[to - asked[i]:to])
        few = np.flatnonzero(np.repeat(~many, asked))
        edges = np.searchsorted(few, edges)
        words = lambda at, some: self.word(edges if some is None else np.searchsorted(some, edges), at)
        out[few] = _first_from(words, np.repeat(low, asked)[few], np.repeat(high, asked)[few], least[few])
        return out


@dataclass(frozen=True)
class Vocabulary:
    """Numbers of the learning tokens: 1 + shard + shards * rank by falling count in the shard.  0 is the begin mark."""
    uri: str
    shards: int
    tokens: int                 # learning tokens (N)
    types: int                  # distinct learning tokens (V)
    limit: int                  # above all numbers; stands for unknown words
    stored: frozenset           # shards written

    @property
    def bits(self) -> int:
        return self.limit.bit_length()

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of word hashes."""
        number, count = np.full(len(hashes), self.limit, np.uint64), np.zeros(len(hashes), np.uint64)
        order, hashes = (None, hashes) if (hashes[1:] >= hashes[:-1]).all() else _numbered(hashes)
        shard = shard_of(hashes, 64, self.shards)
        edge = np.append(run_starts(shard), len(hashes))
        for lo, hi in zip(edge.tolist(), edge[1:].tolist()):
            s = int(shard[lo])
            # a shard that was written and cannot be read is an error, never a count of 0
            if s in self.stored:
                names = _shard(self.uri, f"raw0-{s}.key", "<u8", 1)
                i = np.minimum(np.searchsorted(names, hashes[lo:hi]), len(names) - 1)
                hit = np.flatnonzero(names[i] == hashes[lo:hi])
                i, hit = i[hit], lo + hit if order is None else order[lo + hit]
                number[hit] = _shard(self.uri, f"raw0-{s}.rank", "<u4", 1)[i].astype(np.uint64) * np.uint64(self.shards) + np.uint64(1 + s)
                count[hit] = _counts(self.uri, f"raw0-{s}", 1, i)
        return number, count


@dataclass(frozen=True)
class Model:
    """Where the shards are, and the sums that all of them share."""
    vocabulary: Vocabulary
    order: int
    discounts: tuple            # per order from 1: D1, D2, D3+
    unigram: tuple              # continuation total, N1, N2, N3+, distinct words
    stored: frozenset           # (order, shard) of the shards written; 0 is the tokens' own counts

    @property
    def uri(self) -> str:
        return self.vocabulary.uri

    @property
    def tokens(self) -> int:
        return self.vocabulary.tokens

    def _continuations(self, number: np.ndarray) -> np.ndarray:
        """Counts of order 1 of word numbers."""
        out = np.zeros(len(number), np.uint64)
        known = np.flatnonzero(number < self.vocabulary.limit)
        rank, shard = np.divmod(number[known] - np.uint64(1), np.uint64(self.vocabulary.shards))
        for s, pick in _by_shard(shard.astype(np.int64)):
            if (1, s) in self.stored:
                out[known[pick]] = _counts(self.uri, f"gram1-{s}", 1, rank[pick].astype(np.int64))
        return out

    def _find(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of n-grams in the order of their contexts' keys; in this order, their counts
        and, in rows, their contexts' total and numbers of n-grams counted 1, 2, 3 and more times (0 where absent)."""
        k, bits = len(columns), self.vocabulary.bits
        order, key = _numbered(context_key(columns[:-1], bits))
        word = columns[-1][order]
        count, stats = np.zeros(len(key), np.int64), np.zeros((4, len(key)), np.int64)
        shard = shard_of(key, key_width(k - 1, bits), self.vocabulary.shards)
        edge = np.append(run_starts(shard), len(key))
        stored = [(s, lo, hi) for s, lo, hi in zip(shard[edge[:-1]].tolist(), edge.tolist(), edge[1:].tolist()) if (k, s) in self.stored]
        while stored:       # shards that follow one another, until enough is asked of them
            n = next((i for i in range(1, len(stored)) if stored[i][1] > stored[i - 1][2] or stored[i][1] - stored[0][1] >= GROUP), len(stored))
            (_, lo, _), (_, _, hi) = stored[0], stored[n - 1]
            shards = Shards([_gram_shard(self.uri, f"gram{k}-{s}", bits) for s, _, _ in stored[:n]])
            count[lo:hi], stats[:, lo:hi] = shards.find(np.array([*[v[1] for v in stored[:n]], hi]) - lo, key[lo:hi], word[lo:hi])
            stored = stored[n:]
        return order, count, stats

    def _look_up(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same in the n-grams' own order, with a row of stats for each."""
        order, count, stats = self._find(columns)
        own = np.argsort(order)
        return count[own], stats.T[own]

    def score(self, x: np.ndarray, position: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Per text of the given tokens: n_tokens, n_known, base_score and score (log10 probabilities)."""
        real = np.flatnonzero(position > 0)
        distinct, inverse = _unique(x)
        number, raw = self.vocabulary.look_up(distinct)
        place, word = position[real], inverse[real].astype(np.int64)
        first = np.cumsum(n) - n
        add = lambda v: np.add.reduceat(v, first) if len(first) else np.zeros(0)
        out = {"n_tokens": n.astype(np.int64), "n_known": add((raw > 0).astype(np.int64)[word]),
               "base_score": add(np.log10((raw + 0.5) / (self.tokens + 0.5 * (self.vocabulary.types + 1)))[word])}
        total, n1, n2, n3, types = self.unigram
        a = self._continuations(number)
        numbers, x = _local(number, inverse, position)
        uniform = 1.0 / (types + 1)
        if total:
            d = (0.0, *self.discounts[0])
            left = (d[1] * n1 + d[2] * n2 + d[3] * n3) / total
            p = (np.maximum(a - np.take(d, np.minimum(a, 3).astype(int)), 0) / total + left * uniform)[word]
        else:
            p = np.full(len(real), uniform)
        del inverse, word
        # a context is the number of an n-gram of the order below, the columns have the n-grams' words
        context, columns, bits = x, [numbers], np.uint64(len(numbers).bit_length())
        for k in range(2, self.order + 1):
            at = np.flatnonzero(place >= k - 1)
            if not len(at):
                break
            order, grams = _numbered(context[real[at] - 1] << bits | x[real[at]])
            at, new = at[order], _starts(grams)
            grams = grams[new]
            before = (grams >> bits).astype(np.int64)
            columns = [*[c[before] for c in columns], numbers[grams & _ones(int(bits))]]
            del grams, before
            order, a, stats = self._find(columns)
            d = np.array((0.0, *self.discounts[k - 1]))
            left = stats[1] * d[1] + stats[2] * d[2] + stats[3] * d[3]
            left[stats[0] == 0], total = 1, np.maximum(stats[0], 1)    # a context that was not seen leaves p as it is
            a, left = np.maximum(a - d[np.minimum(a, 3)], 0) / total, left / total
            own = np.empty(len(order), np.int64)
            own[order] = np.arange(len(order))
            gram = own[np.cumsum(new) - 1]
            p[at] = a[gram] + left[gram] * p[at]
            if k < self.order:
                context, columns = np.zeros(len(x), np.uint64), [c[order] for c in columns]
                context[real[at]] = gram
        return out | {"score": add(np.log10(p))}


def _local(number: np.ndarray, inverse: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of the given word numbers, after that of the begin mark, and the place in them of each token's."""
    numbers, rank = _ranks(number)
    return np.append(np.uint64(0), numbers), np.where(position > 0, (rank + np.uint64(1))[inverse], np.uint64(0))


def _together(texts: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``token_rows`` of batches of one column, put together until they have so many tokens."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for b in texts:
        held.append(token_rows(b.column(0)))
        size += len(held[-1][0])
        if size >= tokens:
            yield tuple(np.concatenate(h) for h in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(h) for h in zip(*held, strict=True))


def _in_task(rows):
    """The task that makes ``rows`` of the hashes and positions of every ``FLUSH_TOKENS`` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, position, _ in _together(blocks(batches, "text", TEXT_BYTES), FLUSH_TOKENS):
            yield _batch(rows(x, position))

    return run


def _word_rows(shards: int):
    def rows(x: np.ndarray, position: np.ndarray) -> list[tuple]:
        (words,), counts = _grams([x[position > 0]], 64, None)
        s = shard_of(words, 64, shards)
        edge = np.append(run_starts(s), len(s))
        return [(0, int(s[a]), d) for a, b in zip(edge.tolist(), edge[1:].tolist()) for d in _pack([words[a:b]], counts[a:b])]

    return rows


def _number_words(shards: int, uri: str):
    """Write a shard of the vocabulary; its sums are a kind -1 row."""
    def number(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[1].as_py()
        (words,), counts = _unpacked(batches)
        at, counts = _distinct([words], [64], counts)
        rank = np.empty(len(at), "<u4")
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(at))
        store = Store(uri)
        store.write(f"raw0-{shard}.rank", rank)
        store.write_counts(f"raw0-{shard}", counts)
        store.write(f"raw0-{shard}.key", words[at].astype("<u8"))
        yield _batch([(-1, shard, np.array([counts.sum(), len(at), 1 + shard + shards * (len(at) - 1)], np.int64).tobytes())])

    return number


def _count_rows(vocabulary: Vocabulary, order: int):
    def rows(x: np.ndarray, position: np.ndarray) -> list[tuple]:
        distinct, inverse = _unique(x)
        numbers, x = _local(vocabulary.look_up(distinct)[0], inverse, position)
        out = []

        def add(kind: int, at: np.ndarray) -> None:
            if len(at):
                out.extend(_rows(kind, [x[at - j] for j in range(kind - 1, -1, -1)], None, vocabulary.bits, vocabulary.shards, numbers))

        add(order, np.flatnonzero(position >= max(order - 1, 1)))
        for k in range(2, order):   # n-grams that begin a text, below the highest order
            add(k, np.flatnonzero(position == k - 1))
        return out

    return rows


def _reduce(now: int, vocabulary: Vocabulary):
    """Merge a shard: kind ``now`` is written and summed up as a kind -1 row;
    its suffixes and lower kinds are sent on."""
    bits, shards = vocabulary.bits, vocabulary.shards

    def reduce(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, shard = key[0].as_py(), key[1].as_py()
        if kind < 0:
            yield _batch([(kind, shard, d) for b in batches for d in b.column(b.schema.get_field_index("data")).to_pylist()])
            return
        columns, counts = _unpacked(batches)
        if kind > 1:
            least = columns[0].min()
            at, counts = _distinct([columns[0] - least, columns[-1]], [int(columns[0].max() - least).bit_length(), bits], counts)
        else:
            at, counts = _distinct(columns, [bits], counts)
        columns = [c[at] for c in columns]
        if kind > 1:    # a key that is no hash came in its context's place
            context = columns[0]
            columns = [*_of_key(context, kind - 1, bits), columns[-1]] if (kind - 1) * bits <= 64 else columns[1:]
        if kind < now:
            yield _batch(_rows(kind, columns, counts, bits, shards))
            return
        store, name = Store(vocabulary.uri), f"gram{kind}-{shard}"
        few = [int((counts == i).sum()) for i in (1, 2, 3, 4)] + [int((counts >= 3).sum()), int(counts.sum()), len(counts)]
        out = [(-1, shard, np.array([kind, *few], np.int64).tobytes())]
        if kind > 1:
            _write_shard(store, name, context, columns[-1], counts, bits)
            out += _rows(kind - 1, columns[1:], None, bits, shards)
        else:               # by rank
            rank = ((columns[0] - np.uint64(1)) // np.uint64(shards)).astype(np.int64)
            by_rank = np.zeros(rank[-1] + 1, np.int64)
            by_rank[rank] = counts
            store.write_counts(name, by_rank)
        yield _batch(out)

    return reduce


def number_words(d: DataFrame, shard_chars: int, uri: str) -> Vocabulary:
    """Count the tokens of column ``text`` and store their numbers."""
    chars = d.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    rows = d.mapInArrow(_in_task(_word_rows(shards)), _SHARDS).groupBy("kind", "shard").applyInArrow(_number_words(shards, uri), _SHARDS)
    sums = {r.shard: [int(v) for v in np.frombuffer(r.data, np.int64)] for r in rows.collect()}
    return Vocabulary(uri, shards, sum(v[0] for v in sums.values()), sum(v[1] for v in sums.values()), 1 + max((v[2] for v in sums.values()), default=0), frozenset(sums))


def fit(docs: DataFrame, text: str = "text", order: int = ORDER, shard_chars: int = SHARD_CHARS) -> Model:
    """Count all texts of ``docs`` and store the model in the checkpoint folder."""
    checkpoint_dir(docs.sparkSession)
    # with the scheme of its store: workers open it without Spark's settings
    uri = f"{docs.sparkSession.sparkContext.getCheckpointDir()}/kn-{uuid.uuid4().hex}"
    d = docs.select(F.col(text).alias("text"))
    vocabulary = number_words(d, shard_chars, uri)
    rows = d.mapInArrow(_in_task(_count_rows(vocabulary, order)), _SHARDS)
    for now in range(order, 0, -1):
        rows = rows.groupBy("kind", "shard").applyInArrow(_reduce(now, vocabulary), _SHARDS)
    sums: dict[int, np.ndarray] = {}
    stored = {(0, s) for s in vocabulary.stored}
    for r in rows.where("kind = -1").collect():
        kind, *few = np.frombuffer(r.data, np.int64)
        stored.add((int(kind), r.shard))
        sums[int(kind)] = sums.get(int(kind), 0) + np.array(few)
    none = np.zeros(7, np.int64)
    first = sums.get(1, none)
    return Model(vocabulary, order, tuple(_discounts(sums.get(k, none)) for k in range(1, order + 1)),
                 tuple(int(v) for v in (first[5], first[0], first[1], first[4], first[6])), frozenset(stored))


def _discounts(s: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts 1 to 4; half a
    count where the corpus is too small to tell."""
    n = [float(v) for v in s[:4]]
    if min(n[:3]) <= 0:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), float(i)) for i in (1, 2, 3))


def scores(text: Column, spark, model: Model) -> Column:
    """struct<n_tokens, n_known, base_score, score> of a text column."""
    @arrow_udf("struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("n_tokens", "n_known", "base_score", "score")
        for rows in _together(blocks((pa.RecordBatch.from_arrays([a], ["t"]) for a in batches), "t", TEXT_BYTES), SCORE_TOKENS):
            got = model.score(*rows)
            yield pa.StructArray.from_arrays([pa.array(got[n]) for n in names], names)

    return score(text)


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)
