"""Substring dedup by recompression.

A word that lies in a window of ``WINDOW`` words whose sequence also starts
earlier (smaller id, or earlier in the document) is removed.

Recompression: words are symbols; a round names every maximal run of one symbol
and then every pair of a left-class and a right-class neighbour, the class being
a bit of the symbol's hash.  Names are hashes of what they stand for, so they
agree over all documents without a table.  How a symbol came about depends on
its own words and a few neighbours - its context, kept as a word range.  Every
occurrence of a window parses alike wherever a context lies inside the window.
So a window with an inner symbol whose name occurs once in the corpus cannot
repeat.  Of the others each is found by its anchor, the first symbol of the highest
level inside it: windows with anchors of one name are candidates, and extending the
anchors left and right over the window's other words verifies them (96 bits).

Spark does it in three looks at chunks of documents (``CHUNK_CHARS``, by hash
of the id): chunks send their distinct names, packed, to a task per hash range,
which answers with a bit for each - found in another chunk or not; chunks send
the first start of each window left, and the range's task answers whether it
starts earlier elsewhere; chunks then remove what repeats.  A name or window
that stands in a text a million times is sent once by each chunk.

Null and empty texts have no words and stay as they are; texts shorter than the
window lose nothing; rows that repeat an id come in order of their text; null
ids come last; an empty table gives an empty result; the other columns travel
in one struct, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleval.llm.words import Words, _tables, fields, mix

WINDOW = 20
ROUNDS = 3
CHUNK_CHARS = 4_000_000
SHARD_CHARS = 12_000_000

_RUN, _PAIR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_POLY = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))
_ANSWER = "chunk bigint, kind int, shard int, data binary"


@dataclass
class Level:
    """Symbols after a round, in order: ``name``, own words [a, b), and the word range [lo, hi) that they depend on.
    A range that needs to know where the document ends reaches beyond it."""
    name: np.ndarray
    a: np.ndarray
    b: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def recompress(h: np.ndarray, doc: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """The words, and the symbols after each of ``rounds`` rounds."""
    sym, lo, hi, d, first = h, np.arange(len(h), dtype=np.int32), np.arange(1, len(h) + 1, dtype=np.int32), doc, first.astype(np.int32)
    own, end = lo, hi                                               # a chunk has far fewer than 2^31 words
    levels = [Level(sym, own, end, lo, hi)]
    for r in range(rounds):
        if not len(sym):
            break
        new = np.ones(len(sym), bool)
        new[1:] = (sym[1:] != sym[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(sym)))
        own, end = own[at], end[at + size - 1]
        dd = d[at]
        same = dd[1:] == dd[:-1]
        nlo, nhi = first[dd] - 1, first[dd + 1] + 1
        nlo[1:][same] = lo[at[1:] - 1][same]
        nhi[:-1][same] = hi[at[1:]][same]
        sym = np.where(size > 1, mix(sym[at] * _RUN + size.astype(np.uint64)), sym[at])
        lo, hi, d = nlo, nhi, dd

        left = (mix(sym ^ (_PAIR >> np.uint64(r))) & np.uint64(1)) == 1
        same = np.append(d[1:] == d[:-1], False)                    # the next symbol is of this document
        pair = left & np.append(~left[1:], False) & same
        at = np.flatnonzero(~np.concatenate(([False], pair[:-1])))
        after, before = np.minimum(at + 1, len(sym) - 1), np.maximum(at - 1, 0)
        paired = pair[at]
        nhi = np.where(paired, hi[after], hi[at])
        nlo = lo[at]
        alone = ~paired & left[at]
        nhi = np.where(alone, np.where(same[at], hi[after], first[d[at] + 1] + 1), nhi)
        alone = ~paired & ~left[at]
        nlo = np.where(alone, np.where((at > 0) & same[before], lo[before], first[d[at]] - 1), nlo)
        sym = np.where(paired, mix(sym[at] * _PAIR + sym[after]), sym[at])
        own, end = own[at], np.where(paired, end[after], end[at])
        lo, hi, d = nlo, nhi, d[at]
        levels.append(Level(sym, own, end, lo, hi))
    return levels


def anchors(levels: list[Level], start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, a, b) of the symbol that stands for each window: the first of the highest level whose context lies inside.

    What lies inside is the window's own business, so equal windows have the same one at the same place.
    """
    name, a, b = (np.zeros(len(start), t) for t in (np.uint64, np.int32, np.int32))
    start = start.astype(np.int32)
    left = np.arange(len(start), dtype=np.int32)
    for level in levels[::-1]:                                  # the last level, the words, has one for every window
        if not len(left):
            break
        i = np.searchsorted(level.lo, start[left])              # contexts begin and end in order
        held = np.minimum(i, max(len(level.lo) - 1, 0))
        inside = (i < len(level.lo)) & (level.hi[held] <= start[left] + window) if len(level.lo) else np.zeros(len(left), bool)
        to, held = left[inside], held[inside]
        name[to], a[to], b[to] = level.name[held], level.a[held], level.b[held]
        left = left[~inside]
    return name, a, b


def extended(h: np.ndarray, start: np.ndarray, window: int, anchor: tuple[np.ndarray, np.ndarray, np.ndarray], salt: np.uint64) -> np.ndarray:
    """Hash of each window: its anchor's name, and the words left and right of the anchor."""
    name, a, b = anchor
    up, down = _tables(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:len(h)], out=sums[1:])
    left, right = (sums[a] - sums[start]) * down[start], (sums[start + window] - sums[b]) * down[b]
    del sums
    return mix(mix(left * salt + name) * salt + right + (a - start).astype(np.uint64))


class Chunk:
    """Documents of one chunk in order, parsed."""

    def __init__(self, table: pa.Table, chunk: int, shards: int, window: int, rounds: int):
        ids = table.column("_id").combine_chunks()
        order = pc.sort_indices(table.select(["_id", "text"]), [("_id", "ascending"), ("text", "ascending")])
        self.table, self.shards, self.window = table.take(order), shards, window
        ids = ids.take(order)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        self.key = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        row = np.arange(len(null))
        new = np.concatenate(([True], self.key[1:] != self.key[:-1])) if len(row) else np.zeros(0, bool)
        self.seq = row - np.maximum.accumulate(np.where(new, row, 0))       # number among rows with the same id
        self.seq = np.where(null, (np.int64(chunk + 1) << 32) + row, self.seq)
        self.words = w = Words(self.table.column("text").combine_chunks())
        self.hash = w.hashes()
        self.levels = recompress(self.hash, w.doc, w.first, rounds)
        name, lo, hi = self.levels[-1].name, self.levels[-1].lo, self.levels[-1].hi
        # symbols that some window holds with their context
        d = w.doc[np.clip(lo, 0, max(len(w) - 1, 0))] if len(w) else lo
        inner = (hi - lo <= window) & (lo >= w.first[d]) & (hi <= w.first[d + 1]) if len(w) else np.zeros(0, bool)
        self.lo, self.hi = lo[inner], hi[inner]
        name = name[inner]
        # hash range and a 32-bit mark inside it; equal marks of different names only let more windows through
        self.mark = ((name >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
        self.marks, self.inverse, times = np.unique(self.mark, return_inverse=True, return_counts=True)
        self.local = times > 1

    def names(self) -> list[tuple[int, bytes]]:
        """Distinct marks by hash range."""
        s = (self.marks >> np.uint64(32)).astype(np.int64)
        return [(int(s[a]), (self.marks[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()) for a, b in _ranges(s)]

    def candidates(self, answers: dict[int, bytes]) -> None:
        """Windows without an inner name that occurs once; each distinct one by its first start."""
        repeated = self.local | self._bits(answers, (self.marks >> np.uint64(32)).astype(np.int64))
        w, n = self.words, len(self.words)
        once = ~repeated[self.inverse] if len(self.inverse) else np.zeros(0, bool)
        a, b = np.maximum(self.hi[once] - self.window, 0), self.lo[once] + 1
        held = np.cumsum(np.bincount(a, minlength=n + 1)[:n + 1] - np.bincount(b, minlength=n + 1)[:n + 1])[:n]
        fits = np.arange(n) + self.window <= w.first[w.doc + 1] if n else np.zeros(0, bool)
        self.start = np.flatnonzero(fits & (held == 0))
        anchor = anchors(self.levels, self.start, self.window)
        self.levels = None
        h1 = extended(self.hash, self.start, self.window, anchor, _POLY[0])
        h2 = extended(mix(self.hash + np.uint64(7)), self.start, self.window, (mix(anchor[0] + np.uint64(7)), *anchor[1:]), _POLY[1])
        h2 = h2 >> np.uint64(32)
        order = np.lexsort((h2, h1))                    # stable: equal windows stay in order of their start
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        self.is_first = np.zeros(len(order), bool)
        self.is_first[order[new]] = True
        f = np.flatnonzero(self.is_first)
        s = ((h1[f] >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(s, kind="stable")
        self.sent, self.sent_shard, self.h1, self.h2 = f[by], s[by], h1[f[by]], h2[f[by]]

    def windows(self) -> list[tuple[int, bytes]]:
        """First starts of the distinct candidates by hash range: hash, place in the corpus."""
        w = self.words
        start = self.start[self.sent]
        d = w.doc[start] if len(start) else start
        place = start - w.first[d]
        cols = (self.h1, self.key[d], self.seq[d], self.h2.astype(np.uint32), place.astype(np.uint32))
        return [(int(self.sent_shard[a]), b"".join(c[a:b].tobytes() for c in cols)) for a, b in _ranges(self.sent_shard)]

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Words covered by a window that starts earlier elsewhere or in this chunk."""
        late = ~self.is_first
        late[self.sent] = self._bits(answers, self.sent_shard)
        n = len(self.words)
        s = self.start[late]
        cover = np.bincount(s, minlength=n + 1)[:n + 1] - np.bincount(s + self.window, minlength=n + 1)[:n + 1]
        return np.cumsum(cover)[:n] > 0

    @staticmethod
    def _bits(answers: dict[int, bytes], shard: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shard), bool)
        for a, b in _ranges(shard):
            data = answers.get(int(shard[a]))
            if data is None:
                raise RuntimeError("an answer for a sent hash range is missing")
            out[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
        return out

    def kept(self, gone: np.ndarray) -> pa.RecordBatch:
        w = self.words
        lost = np.bincount(w.doc[gone], minlength=len(w.offsets) - 1)
        text = self.table.column("text").combine_chunks()
        if lost.any():
            texts = text.to_pylist()
            for d in np.flatnonzero(lost):
                a, b = w.first[d], w.first[d + 1]
                keep = ~gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
                ends = np.append(w.start, w.offsets[-1])
                begin = [int(w.offsets[d]) if x == 0 else int(w.start[a + x]) for x in edge[::2]]
                stop = [int(w.offsets[d + 1]) if x == b - a else int(ends[a + x]) for x in edge[1::2]]
                texts[d] = b"".join(w.buf[x:y].tobytes() for x, y in zip(begin, stop, strict=True)).decode("utf-8", "surrogatepass")
            text = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([self.table.column("row").combine_chunks(), text.cast(pa.string()), pa.array(w.counts.astype(np.int64)),
                                           pa.array(lost.astype(np.int64))], ["row", "text", "n_words", "n_removed"])


def _ranges(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_values):
        return []
    at = np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))
    return [(int(a), int(b)) for a, b in zip(at, at[1:])]


def _answer(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(cols, ("int64", "int32", "int32", "binary"), strict=True)], ["chunk", "kind", "shard", "data"])


def _seen_elsewhere(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A bit for each mark of each chunk: another chunk has it too."""
    parts = [np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]
    every = np.sort(np.concatenate(parts))
    twice = every[1:][every[1:] == every[:-1]]          # a chunk has a mark once
    rows = []
    for chunk, marks in zip(table.column("chunk").to_pylist(), parts, strict=True):
        at = np.minimum(np.searchsorted(twice, marks), max(len(twice) - 1, 0))
        hit = twice[at] == marks if len(twice) else np.zeros(len(marks), bool)
        rows.append((chunk, 0, key[0].as_py(), np.packbits(hit).tobytes()))
    return _answer(rows)


def _starts_earlier(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A bit for each window of each chunk: another chunk has it at an earlier place."""
    h1, h2, ids, seq, place, size = [], [], [], [], [], []
    for x in table.column("data").to_pylist():
        n = len(x) // 32
        h1.append(np.frombuffer(x, np.uint64, n))
        ids.append(np.frombuffer(x, np.int64, n, 8 * n))
        seq.append(np.frombuffer(x, np.int64, n, 16 * n))
        h2.append(np.frombuffer(x, np.uint32, n, 24 * n))
        place.append(np.frombuffer(x, np.uint32, n, 28 * n))
        size.append(n)
    a, b = np.concatenate(h1), np.concatenate(h2)
    order = np.lexsort((np.concatenate(place), np.concatenate(seq), np.concatenate(ids), b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    late = np.ones(len(order), bool)
    late[order[new]] = False
    ends = np.cumsum(size)
    return _answer([(chunk, 1, key[0].as_py(), np.packbits(late[e - n:e]).tobytes())
                    for chunk, n, e in zip(table.column("chunk").to_pylist(), size, ends, strict=True)])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list | None = None, window: int = WINDOW,
                     rounds: int = ROUNDS, chunk_chars: int = CHUNK_CHARS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per input row: ``row`` (struct of ``keep``), ``text`` without the
    removed words, ``n_words`` and ``n_removed``."""
    chars = docs.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
    chunks, shards = max(1, -(-chars // chunk_chars)), max(1, -(-chars // shard_chars))
    keep = keep or [c for c in docs.columns if c != text]
    key = F.coalesce(F.xxhash64(doc_id), F.lit(0))
    key = F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(key)
    d = docs.select(F.pmod(key, F.lit(chunks)).alias("chunk"), F.col(doc_id).cast("bigint").alias("_id"), F.col(text).cast("string").alias("text"),
                    fields(keep))

    def parse(table: pa.Table) -> tuple[int, Chunk]:
        number = table.column("chunk")[0].as_py()
        return number, Chunk(table, number, shards, window, rounds)

    def send_names(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number, c = parse(table)
        c.levels = None
        return _answer([(number, 0, s, x) for s, x in c.names()])

    def answers(table: pa.Table, kind: int) -> dict[int, bytes]:
        return {s: x for k, s, x in zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "data")), strict=True) if k == kind}

    def send_windows(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _answer([])
        number, c = parse(left)
        c.candidates(answers(right, 0))
        return _answer([(number, 1, s, x) for s, x in c.windows()])

    result = T.StructType([T.StructField("row", d.schema["row"].dataType), T.StructField("text", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        _, c = parse(left)
        c.candidates(answers(right, 0))
        return pa.Table.from_batches([c.kept(c.removed(answers(right, 1)))])

    names = d.groupBy("chunk").applyInArrow(send_names, _ANSWER)
    seen = names.groupBy("shard").applyInArrow(_seen_elsewhere, _ANSWER)
    found = d.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(send_windows, _ANSWER)
    earlier = found.groupBy("shard").applyInArrow(_starts_earlier, _ANSWER)
    told = seen.unionByName(earlier)
    return d.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(cut, result)


def dedup(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The documents with the removed words cut out (all columns; a length column follows the text)."""
    others = [c for c in docs.columns if c != text]
    out = dedup_substrings(docs, text=text, keep=others, **options)

    def column(c: str) -> Column:
        if c == text:
            return F.col("text").alias(c)
        old = F.col("row").getField(c)
        if c == n_chars:
            old = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(old).cast(docs.schema[c].dataType)
        return old.alias(c)

    return out.select(*[column(c) for c in docs.columns])
