"""Benchmark decontamination by pigeonhole edit matching.

A document holds a benchmark item if some stretch of it is within the item's
error budget (``RATE`` of its characters) in edit distance.  The item is cut
into budget + 1 pieces; with so few edits one piece at least stands unchanged.
All pieces are searched at once in the whole text (Aho-Corasick); a hit says
where the item would lie, and that stretch, widened by the budget, is verified
with Myers' bit-parallel distance.

Letters A-Z are folded and every white space character counts as a space, both
one to one, so offsets are those of the original text.

The items are the query set: their text is measured first and sent in slices of
``SLICE_CHARS`` characters, about (an item stays whole), with one pass over the
documents for each slice, so a worker holds one slice's pieces whatever the items'
number (about 55 bytes a character).  Of overlapping places of one item the one with
the least distance counts, then the one that ends first.

Null and empty texts hold nothing; null and empty items are in nothing; an item
shorter than ``1 / RATE`` must occur unchanged; equal items give one match each;
repeated rows give equal matches; empty tables give an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from moleval.llm.words import fields
from moleval.session import cut_lineage

RATE = 0.08
SLICE_CHARS = 4_000_000
NAMES = ("item_id", "distance", "start", "end")

_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b"     ")


def fold(text: str | None) -> str:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass")


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate)


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 consecutive pieces of even length."""
    n = budget(len(item), rate) + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:]) if b > a]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance between ``pattern`` and any stretch of ``text``
    (``anchored``: any beginning of it), and the end of the first such stretch.

    One column of the edit matrix is kept as two bit masks of its vertical
    steps up and down, so a text character costs a few operations on whole
    machine integers.
    """
    m = len(pattern)
    at: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        at[ch] |= 1 << i
    ones, top, first = (1 << m) - 1, 1 << (m - 1), int(anchored)
    plus, minus, score = ones, 0, m
    best, end = m, 0
    for j, ch in enumerate(text, 1):
        eq = at.get(ch, 0)
        free = eq | minus
        diagonal = ((((eq & plus) + plus) ^ plus) | eq) & ones
        up = minus | (ones & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = ((up << 1) | first) & ones
        down = (down << 1) & ones
        plus = down | (ones & ~(free | up))
        minus = up & free
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """All items of a slice as one automaton over their pieces."""

    def __init__(self, items: list[tuple], rate: float):
        self.items = [(key, fold(text)) for key, text in items]
        self.budgets = [budget(len(t), rate) for _, t in self.items]
        self.owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t) in enumerate(self.items):
            for at, piece in pieces(t, rate):
                self.owners[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece in self.owners:
            self.automaton.add_word(piece, piece)
        if self.owners:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple]:
        """(item key, distance, start, end) of every item found, one per place."""
        if not text or not self.owners:
            return []
        folded = fold(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for last, piece in self.automaton.iter(folded):
            for n, at in self.owners[piece]:
                starts[n].add(last + 1 - len(piece) - at)
        out = []
        for n, where in starts.items():
            key, item = self.items[n]
            k = self.budgets[n]
            places: list[list[int]] = []
            for s in sorted(where):
                if places and s <= places[-1][1] + 2 * k:
                    places[-1][1] = s
                else:
                    places.append([s, s])
            for lo, hi in places:
                found = self._verify(item, folded, max(0, lo - k), min(len(folded), hi + len(item) + k), k)
                if found:
                    out.append((key, *found))
        return out

    @staticmethod
    def _verify(item: str, text: str, lo: int, hi: int, k: int) -> tuple[int, int, int] | None:
        window = text[lo:hi]
        at = window.find(item)
        if at >= 0:
            return 0, lo + at, lo + at + len(item)
        if not k:
            return None
        distance, end = myers(item, window)
        if distance > k:
            return None
        # the stretch's start: match backwards from its end
        _, back = myers(item[::-1], window[max(0, end - len(item) - k):end][::-1], anchored=True)
        return distance, lo + end - back, lo + end


def _slices(items: DataFrame, item_id: str, text: str, slice_chars: int) -> Iterator[list[tuple]]:
    t = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where(F.length("t") > 0)
    n = max(1, math.ceil((t.agg(F.sum(F.length("t"))).first()[0] or 0) / slice_chars))
    for s in range(n):
        rows = t.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == s) if n > 1 else t
        yield sorted(((r.i, r.t) for r in rows.collect()), key=repr)


_loaded: dict[str, Matcher] = {}      # of a Python worker: the slice it used last


def _matcher(key: str, items: list[tuple], rate: float) -> Matcher:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Matcher(items, rate)
    return _loaded[key]


def finders(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", rate: float = RATE, slice_chars: int = SLICE_CHARS) -> list:
    """A function of a text column for each slice of the items: array<struct<item_id, distance, start, end>>
    of the items that a document's text holds (``end`` exclusive, in characters)."""
    kind = T.ArrayType(T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("distance", T.IntegerType()),
                                     T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    context = docs.sparkSession.sparkContext
    return [_finder(context.broadcast(some), rate, kind) for some in _slices(items, item_id, item_text, slice_chars)]


def _finder(sent, rate: float, kind: T.DataType):
    key, arrow = uuid.uuid4().hex, to_arrow_type(kind)

    @arrow_udf(kind)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _matcher(key, sent.value, rate)
        for a in batches:
            yield pa.array([[dict(zip(NAMES, x, strict=True)) for x in m.matches(t)] for t in a.to_pylist()], type=arrow)

    return find


def matches(docs: DataFrame, items: DataFrame, keep: list | None = None, text: str = "text", **options) -> DataFrame:
    """One row per item found in a document: ``row`` (struct of ``keep``), ``item_id``, ``distance``, ``start``, ``end``."""
    passes = [docs.select(fields(keep or docs.columns), F.explode(find(F.col(text))).alias("m")) for find in finders(docs, items, **options)]
    return reduce(DataFrame.union, passes).select("row", "m.*")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no item.  Between slices what is left is written, so a task has one slice."""
    for n, find in enumerate(finders(docs, items, **options)):
        left = cut_lineage(docs) if n else docs
        docs = left.select(fields(left.columns), F.size(find(F.col(text))).alias("n")).where("n = 0").select("row.*")
    return docs
