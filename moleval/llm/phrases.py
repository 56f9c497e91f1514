"""Phrase collocations: counts by multikey three-way quicksort of suffix pointers.

A suffix is a word with the words that follow it in its piece, up to the longest
phrase.  Tasks read blocks of texts, add up equal suffixes and route them by a hash
of their leading words, so that all suffixes of a leading word meet in one bucket.
There pointers to the suffixes are sorted one word a level: a partition equal in
its first k words adds up to the count of that phrase, a partition below the least
count is abandoned, and the others are sorted by the next word.  Spark then adds
the counts up, scores every cut of the frequent phrases by joins and ranks them.

A leading word (or pair, and so on) with more suffixes than half a bucket is dealt
over as many buckets as it needs by its next word; its partial counts are never
abandoned and are added up by Spark, its longer phrases stay whole.  Such leads
come from a count over all texts: blocks report leads from ``1 / LEADS`` of their
words on, so the list that is broadcast has ``2 * LEADS`` entries per length at
most, and a lead that is not split has about ``1 / LEADS`` of all words at most.

Null texts and texts without words have no phrases; a null group is ``und``; long
texts are one block each; repeated rows count as often as they stand; equal scores
are ranked by count, then by the phrase's bytes; an empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moleval.llm.words import _LOWER, _offsets, blocks, mix, run_starts
from moleval.operators.common import null_safe_join
from moleval.session import cut_lineage

MAX_WORDS = 3
MIN_COUNT = 10
COVERED_PERCENT = 50
TOP = 2000
NO_GROUP = "und"
BLOCK = 4 << 20                 # bytes of text whose suffixes are added up and routed together
BUCKET = 1 << 20                # suffixes of one bucket, about
LEADS = 1 << 16
SMALL = 1 << 13                 # pointers that are sorted by all remaining words at once
SCORE = 1_000_000

_GAP = np.zeros(256, bool)
_GAP[[32, 9]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True


class Suffixes:
    """Distinct suffixes of a block of texts.

    ``words``: the block's distinct words; ``key``: (max_words + 1, n) columns of
    group number and word numbers, -1 after a piece's end; ``many``: how often.
    """

    def __init__(self, texts: pa.Array, groups: np.ndarray, max_words: int):
        off, buf = _offsets(texts)
        buf = _LOWER[buf]
        n = len(buf)
        stop = _STOP[buf]
        word = ~(stop | _GAP[buf])
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        begins, ends = word.copy(), word.copy()
        if n:
            begins[1:] &= ~word[:-1] | edge[1:n]
            ends[:-1] &= ~word[1:] | edge[1:n]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.searchsorted(off, start, "right") - 1
        stops = np.concatenate(([0], np.cumsum(stop)))
        linked = np.zeros(len(start), bool)
        linked[:-1] = (doc[1:] == doc[:-1]) & (stops[start[1:]] == stops[end[:-1]])
        bounds = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf[word]))]).dictionary_encode()
        self.words = coded.dictionary
        code = coded.indices.to_numpy().astype(np.int32)
        keys = [groups[doc].astype(np.int32), code]
        alive = np.ones(len(start), bool)
        for k in range(1, max_words):
            alive = alive & np.concatenate((linked[k - 1:], np.zeros(min(k - 1, len(linked)), bool)))
            nxt = np.full(len(start), -1, np.int32)
            nxt[:max(0, len(start) - k)] = code[k:]
            keys.append(np.where(alive, nxt, np.int32(-1)))
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        self.key = np.stack([k[first] for k in keys]) if len(first) else np.zeros((max_words + 1, 0), np.int32)
        self.many = np.diff(np.append(first, len(order)))

    def lead_hashes(self, names: list[str]) -> list[np.ndarray]:
        """For k = 1, 2, ...: a hash of the group and the first k words of every suffix."""
        of_word = np.array([xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()] + [0], np.uint64)
        h = mix(np.array([xxhash.xxh64_intdigest(g) for g in names], np.uint64) + np.uint64(1))[self.key[0]]
        out = []
        for column in self.key[1:]:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + of_word[column])
            out.append(h)
        return out


def _group_codes(column: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _blocks(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[tuple[list[str], Suffixes]]:
    for b in blocks(batches, "text", BLOCK):
        names, codes = _group_codes(b.column(0))
        s = Suffixes(b.column(1), codes, max_words)
        if len(s.many):
            yield names, s


@dataclass(frozen=True)
class Routes:
    """Number of buckets; for each length of lead the hashes of split leads (sorted) and over how many buckets they go."""
    buckets: int
    split: list[tuple[np.ndarray, np.ndarray]]

    def of(self, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, level): level is the number of leading words whose counts are partial there."""
        n = np.uint64(self.buckets)
        bucket, level = hashes[0] % n, np.zeros(len(hashes[0]), np.uint8)
        open_ = np.ones(len(bucket), bool)
        for k, (known, ways) in enumerate(self.split):
            if not len(known):
                break
            at = np.minimum(np.searchsorted(known, hashes[k]), len(known) - 1)
            open_ &= known[at] == hashes[k]
            bucket[open_] = (hashes[k][open_] + hashes[k + 1][open_] % ways[at[open_]]) % n
            level[open_] = k + 1
        return bucket.astype(np.int64), level


def routes(texts: DataFrame, max_words: int, bucket: int = BUCKET, leads: int = LEADS) -> Routes:
    """Buckets for all suffixes of (g, text) rows, and the leads that need several."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, s in _blocks(batches, max_words):
            rows = [(np.zeros(1, np.int64), np.zeros(1, np.uint64), np.array([len(s.many)]))]
            for k, h in enumerate(s.lead_hashes(names)[:-1], 1):
                u, many = np.unique(h, return_counts=True)      # a split deals out distinct suffixes
                heavy = many * leads >= len(s.many)
                rows.append((np.full(heavy.sum(), k), u[heavy], many[heavy]))
            kind, h, many = (np.concatenate(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(h.view(np.int64)), pa.array(many, pa.int64())], ["k", "h", "n"])

    counts = cut_lineage(texts.mapInArrow(count, "k int, h bigint, n bigint").groupBy("k", "h").agg(F.sum("n").alias("n")))
    total = counts.where("k = 0").agg(F.sum("n")).first()[0] or 0
    # an entry has 1 / (2 * leads) of all suffixes at least, so there are 2 * leads of a length at most
    least = max(bucket // 2, total // (2 * leads))
    heavy = sorted((r.k, np.uint64(r.h & (1 << 64) - 1), -(-2 * r.n // bucket)) for r in counts.where((F.col("k") > 0) & (F.col("n") > least)).collect())
    split = [(np.array([h for j, h, _ in heavy if j == k], np.uint64), np.array([w for j, _, w in heavy if j == k], np.uint64)) for k in range(1, max_words)]
    return Routes(max(1, -(-total // bucket)), split)


def _pack(names: list[str], words: pa.Array, key: np.ndarray, many: np.ndarray, level: np.ndarray) -> bytes:
    """Suffixes with the groups and words they use, compressed."""
    groups, group = np.unique(key[0], return_inverse=True)
    used, code = np.unique(key[1:], return_inverse=True)
    none = int(len(used) > 0 and used[0] == -1)                 # number 0 stands for no word
    own = words.take(pa.array(used[none:]))
    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(own)], pa.int64()), own), pa.scalar(" ", pa.large_string())).cast(pa.large_string())
    head = pa.concat_arrays([text, pa.array([names[g] for g in groups], pa.large_string())])
    body = np.concatenate((group[None], code.reshape(key[1:].shape) + (1 - none))).astype("<i4")
    parts = [pa.record_batch([head], ["t"]).serialize().to_pybytes(), body.tobytes(), many.astype("<i8").tobytes(), level.tobytes()]
    plain = np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)
    return zstandard.ZstdCompressor(level=1).compress(plain)


_HEAD = pa.schema([("t", pa.large_string())])


def _unpack(data: bytes, max_words: int) -> tuple[list[str], pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    plain = zstandard.ZstdDecompressor().decompress(data)
    a, b, c, _ = np.frombuffer(plain, "<i8", 4)
    head = pa.ipc.read_record_batch(pa.py_buffer(plain[32:32 + a]), _HEAD).column(0)
    rest = plain[32 + a:]
    return (head[1:].to_pylist(), pc.split_pattern(head[:1], " ").flatten(), np.frombuffer(rest, "<i4", b // 4).reshape(max_words + 1, -1),
            np.frombuffer(rest, "<i8", c // 8, b), np.frombuffer(rest, "u1", -1, b + c))


def route(texts: DataFrame, how: Routes, max_words: int) -> DataFrame:
    """(bucket, data): packed suffixes of every block of (g, text) rows for every bucket."""
    sent = texts.sparkSession.sparkContext.broadcast(how)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, s in _blocks(batches, max_words):
            bucket, level = sent.value.of(s.lead_hashes(names))
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = np.append(run_starts(bucket), len(bucket))
            for a, b in zip(first[:-1], first[1:], strict=True):
                at = order[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a:a + 1]), pa.array([_pack(names, s.words, s.key[:, at], s.many[at], level[at])], pa.binary())], ["bucket", "data"])

    return texts.mapInArrow(deal, "bucket bigint, data binary")


def equal_partitions(keys: list[np.ndarray], many: np.ndarray, level: np.ndarray, min_count: int, small: int = SMALL) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth k: (a pointer into every kept partition equal in its first k + 1 keys, the partition's count).

    Three-way quicksort one key at a time: pointers are split by a pivot into less, equal and
    greater; the equal part's sum is a count.  Partitions below ``min_count`` are abandoned
    unless ``level`` says that their count is partial; a negative key ends a suffix.
    """
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in keys]
    rng = np.random.default_rng(0)

    def whole(p: np.ndarray, depth: int) -> np.ndarray:
        return level[p] <= depth

    def finish(p: np.ndarray, depth: int) -> None:
        """A small partition: sorted by all its remaining keys, counted depth by depth."""
        if depth == len(keys) or not len(p):
            return
        p = p[np.lexsort([k[p] for k in keys[depth:][::-1]])]
        new = np.zeros(len(p), bool)
        new[0] = True
        for d in range(depth, len(keys)):
            k = keys[d][p]
            new[1:] |= k[1:] != k[:-1]
            first = np.flatnonzero(new)
            sums = np.add.reduceat(many[p], first)
            kept = (k[first] >= 0) & ((sums >= min_count) | ~whole(p[first], d))
            found[d].append((p[first[kept]], sums[kept]))
            stay = np.repeat(kept, np.diff(np.append(first, len(p))))
            p, new = p[stay], new[stay]
            if not len(p):
                return

    todo = [(np.arange(len(many)), 0)]
    while todo:
        p, depth = todo.pop()
        if len(p) <= small:
            finish(p, depth)
            continue
        if many[p].sum() < min_count and whole(p, depth).all():
            continue
        k = keys[depth][p]
        pivot = np.median(k[rng.integers(0, len(k), 31)]).astype(k.dtype)
        todo += [(p[k < pivot], depth), (p[k > pivot], depth)]
        equal = p[k == pivot]
        if len(equal) and pivot >= 0:
            count = many[equal].sum()
            if count >= min_count or not whole(equal[:1], depth)[0]:
                found[depth].append((equal[:1], np.array([count])))
                if depth + 1 < len(keys):
                    todo.append((equal, depth + 1))
    return [tuple(np.concatenate(c) for c in zip(*f, strict=True)) if f else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for f in found]


def _bucket_counts(min_count: int, max_words: int):
    def count(table: pa.Table) -> pa.Table:
        names, lists, keys, many, level = zip(*(_unpack(d.as_py(), max_words) for d in table.column("data")), strict=True)
        coded = pa.concat_arrays(lists).cast(pa.large_string()).dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        group = {g: i for i, g in enumerate(sorted({g for part in names for g in part}))}
        columns, at = [], 0
        for part, own, k in zip(names, lists, keys, strict=True):
            word = np.concatenate((np.array([-1], np.int32), code[at:at + len(own)]))
            columns.append(np.concatenate((np.array([group[g] for g in part], np.int32)[k[:1]], word[k[1:]])))
            at += len(own)
        key = np.concatenate(columns, axis=1)
        many, level, columns, lists, coded = np.concatenate(many), np.concatenate(level), None, None, None
        lead = key[0] * np.int64(len(words)) + key[1]
        found = equal_partitions([lead, *key[2:]], many, level, min_count)
        name = pa.array(list(group), pa.large_string())
        total = np.bincount(key[0], many, len(group)).astype(np.int64)
        out = [(name, pa.array([""] * len(name), pa.large_string()), 0, total)]
        for k, (p, sums) in enumerate(found, 1):
            phrase = words.take(pa.array(key[1, p]))
            for j in range(2, k + 1):
                phrase = pc.binary_join_element_wise(phrase, words.take(pa.array(key[j, p])), pa.scalar(" ", pa.large_string()))
            out.append((name.take(pa.array(key[0, p])), phrase, k, sums))
        tables = [pa.table({"g": g.cast(pa.string()), "phrase": t.cast(pa.string()), "k": pa.array(np.full(len(s), k), pa.int32()), "n": pa.array(s, pa.int64())}) for g, t, k, s in out]
        return pa.concat_tables(tables)

    return count


def frequent_phrases(df: DataFrame, text: str = "text", group: str | None = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                     bucket: int = BUCKET, leads: int = LEADS) -> DataFrame:
    """(g, phrase, k, n): phrases of 1 to ``max_words`` words with ``min_count`` occurrences at least in
    their group, and per group a row with k = 0 and the number of its words; written once."""
    g = F.coalesce(F.col(group).cast("string"), F.lit(NO_GROUP)) if group else F.lit("")
    texts = df.select(g.alias("g"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    how = routes(texts, max_words, bucket, leads)
    counts = route(texts, how, max_words).groupBy("bucket").applyInArrow(_bucket_counts(min_count, max_words), "g string, phrase string, k int, n bigint")
    return cut_lineage(counts.groupBy("g", "phrase", "k").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | (F.col("k") == 0)))


def _part(words, first, size):
    return F.array_join(F.slice(words, first, size), " ")


def collocations(frequent: DataFrame, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """(g, phrase, k, a, l, r, n, score) of the candidates (two words or more) that no longer one covers.

    The score of a cut is ``floor(SCORE * a * a / (l * r))`` with the counts of both parts, in exact
    decimals; the lowest cut counts, then the one with fewer words before it.
    """
    words = F.split("phrase", " ")
    one = frequent.where("k > 0").select("g", "phrase", F.col("n").alias("part_n"))
    cand = frequent.where("k > 1").select("g", "phrase", "k", F.col("n").alias("a"))
    cuts = cand.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).withColumn("w", words)
    cuts = cuts.select("g", "phrase", "k", "a", "cut", _part(F.col("w"), F.lit(1), F.col("cut")).alias("left"), _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(one.select("g", F.col("phrase").alias(side), F.col("part_n").alias(name)), ["g", side])
    wide = lambda c: F.col(c).cast("decimal(16,0)")  # noqa: E731   products of two and a factor stay below 10^38
    score = F.expr(f"(cast({SCORE} AS decimal(7,0)) * (_a * _a)) div (_l * _r)")
    cuts = cuts.withColumns({"_a": wide("a"), "_l": wide("l"), "_r": wide("r")}).withColumn("score", score.cast("bigint"))
    best = cuts.groupBy("g", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    # every phrase inside a longer candidate, with the longer one's count
    inner = cand.where("k > 2").select("g", F.col("a").alias("longer"), "k", words.alias("w"))
    inner = inner.select("g", "longer", "w", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.struct(at.alias("at"), size.alias("size")))))).alias("s"))
    longest = inner.groupBy("g", _part(F.col("w"), F.col("s.at"), F.col("s.size")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = (best.join(longest, ["g", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * covered_percent)))
    totals = frequent.where("k = 0").select("g", F.col("n"))
    return null_safe_join(kept, totals, ["g"]).select("g", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")


def top_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of every group by score, count and bytes, with their rank from 1."""
    order = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("bigint"))
