"""SimHash near-duplicates by a binary trie self-join.

A fingerprint is the bitwise majority of the XXH64 values (seed 42) of a text's
word shingles.  The distinct fingerprints form a binary trie.  Its first
``depth`` levels are walked by Spark: every fingerprint goes to its own node
and to the nodes whose path differs in at most ``max_bits`` bits, and each pair
of nodes is one group.  Inside a group the two subtries are walked together,
level by level; a pair of nodes carries the bits that differ so far and is
dropped when they exceed ``max_bits``.  Small pairs are compared directly.

A group gives the links of a spanning forest of what it found (no more rows
than fingerprints), and :func:`connected_components` joins the forests, so no
class is ever expanded into all its pairs.

Null and empty texts have no shingles and fingerprint 0, which is linked like
any other; texts shorter than a shingle are one shingle; equal texts share a
fingerprint and a class; a null id takes part but never names a class unless
all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from moleval.llm.components import connected_components, union
from moleval.llm.words import Words, blocks, fields
from moleval.session import cut_lineage

SHINGLE = 3
MAX_BITS = 3
NODE_SIZE = 1 << 14             # fingerprints aimed at in a trie node that one task holds
FRONTIER = 1 << 19              # node pairs handled at once inside a task
DIRECT = 16                     # node pairs with so few fingerprint pairs are compared directly


def fingerprint_array(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints (uint64) of whole texts."""
    w = Words(texts, lower=True)
    n_docs, out = len(w.offsets) - 1, np.zeros(len(w.offsets) - 1, np.uint64)
    if not len(w):
        return out
    counts = w.counts
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(n_docs), shingles)
    begin = np.cumsum(shingles) - shingles
    first = w.first[doc] + np.arange(len(doc)) - begin[doc]
    last = np.minimum(first + shingle, w.first[doc + 1]) - 1
    gap = np.concatenate(([0], np.cumsum(w.start[1:] - w.end[:-1] != 1)))    # separators of another length
    plain = gap[first] == gap[last]
    buf = w.buf.copy()
    buf[(buf >= 9) & (buf <= 13)] = 32
    data, hash64 = buf.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((hash64(data[s:e], 42) for s, e in zip(w.start[first].tolist(), w.end[last].tolist(), strict=True)), np.uint64, len(doc))
    for i in np.flatnonzero(~plain):
        h[i] = hash64(b" ".join(data[w.start[first[i]]:w.end[last[i]]].split()), 42)
    has = np.flatnonzero(shingles)
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
    votes = np.add.reduceat(bits, begin[has], axis=0, dtype=np.int32)
    out[has] = np.packbits(votes * 2 > shingles[has][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a bigint with the same 64 bits."""
    @arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            t = pa.RecordBatch.from_arrays([a], ["t"])
            parts = [fingerprint_array(b.column(0), shingle).view(np.int64) for b in blocks([t], "t")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return simhash(text)


def near_pairs(a: np.ndarray, b: np.ndarray, level: int, differ: int, max_bits: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with at most ``max_bits`` differing bits between the sorted
    distinct arrays ``a`` and ``b``, whose members share their bits above ``level``
    up to ``differ`` differing ones.  ``same``: a is b, each pair once."""
    zero = np.zeros(1, np.int64)
    stack = [(level, zero, zero + len(a), zero, zero + len(b), np.full(1, differ, np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(bit, *(x[:half] for x in (alo, ahi, blo, bhi, err))), (bit, *(x[half:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        small = (ahi - alo) * (bhi - blo) <= DIRECT
        if bit < 0:
            small[:] = True
        if small.any():
            na, nb = (ahi - alo)[small], (bhi - blo)[small]
            pairs = na * nb
            at = np.repeat(np.arange(len(pairs)), pairs)
            k = np.arange(len(at)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            i, j = alo[small][at] + k // nb[at], blo[small][at] + k % nb[at]
            near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        one, above = np.uint64(1) << np.uint64(bit), ~((np.uint64(2) << np.uint64(bit)) - np.uint64(1)) if bit < 63 else np.uint64(0)
        amid = np.searchsorted(a, (a[alo] & above) | one)
        bmid = np.searchsorted(b, (b[blo] & above) | one)
        children = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        mirrored = (amid, ahi, blo, bmid, err + 1)
        if same:                # the mirror image of a node paired with itself is the same pair
            apart = alo != blo
            mirrored = tuple(x[apart] for x in mirrored)
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*children, mirrored, strict=True))
        live = (alo < ahi) & (blo < bhi) & (err <= max_bits)
        if live.any():
            stack.append((bit - 1, *(x[live] for x in (alo, ahi, blo, bhi, err))))


def _forest(a: np.ndarray, b: np.ndarray | None, level: int, differ: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) of a spanning forest over the near pairs of a and b (or within a)."""
    both = a if b is None else np.concatenate((a, b))
    parent = np.arange(len(both))
    for i, j in near_pairs(a, a if b is None else b, level, differ, max_bits, b is None):
        union(parent, i, j if b is None else j + len(a))
    member = np.flatnonzero(parent != np.arange(len(both)))
    return both[member], both[parent[member]]


def links(fps: DataFrame, max_bits: int = MAX_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``fp`` at most ``max_bits`` apart.

    ``depth`` follows the number of fingerprints, so a node holds about
    ``node_size`` of them; ``C(depth, 0..max_bits)`` copies of each are shuffled
    as packed arrays.
    """
    n = fps.count()
    depth = min(24, max(1, math.ceil(math.log2(max(n, 1) / node_size)))) if n > node_size else 0
    masks = [sum(1 << i for i in c) for k in range(min(max_bits, depth) + 1) for c in combinations(range(depth), k)]
    prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("bigint")

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(b.schema.get_field_index("fp")).to_numpy(zero_copy_only=False) for b in batches]
        yield pa.RecordBatch.from_pydict({"p": pa.array([key[0].as_py()], "int64"), "fps": [np.sort(np.concatenate(parts).view(np.uint64)).tobytes()]})

    nodes = fps.select("fp", prefix.alias("p")).groupBy("p").applyInArrow(pack, "p bigint, fps binary")
    each = F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks]))
    pairs = (nodes.select("p", "fps", each.alias("m"))
             .select(F.least("p", F.col("p").bitwiseXOR(F.col("m"))).alias("k"), "m", "p", "fps"))

    def walk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [np.frombuffer(x, np.uint64) for b in batches for x in b.column(b.schema.get_field_index("fps")).to_pylist()]
        differ = bin(key[1].as_py()).count("1")
        if differ and len(sides) < 2:
            return
        x, y = _forest(sides[0], sides[1] if differ else None, 63 - depth, differ, max_bits)
        yield pa.RecordBatch.from_pydict({"a": pa.array(x.view(np.int64)), "b": pa.array(y.view(np.int64))})

    return pairs.groupBy("k", "m").applyInArrow(walk, "a bigint, b bigint")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list | None = None,
                 shingle: int = SHINGLE, max_bits: int = MAX_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """One row per input row: ``row`` (struct of ``keep``), ``fp`` and ``component_id``,
    the smallest id among all documents reachable over links of near fingerprints.

    Fingerprints are written once to the checkpoint folder and used for the
    classes and for the result.
    """
    rows = cut_lineage(docs.select(fields(keep or docs.columns),
                                   F.col(doc_id).alias("_id"), fingerprint(F.col(text), shingle).alias("fp")))
    ids = cut_lineage(rows.groupBy("fp").agg(F.min("_id").alias("_id")))
    comp = connected_components(links(ids.select("fp"), max_bits, node_size))
    known = (ids.join(comp, ids["fp"] == comp["node"], "left")
             .select("fp", "_id", F.coalesce("root", "fp").alias("root")))
    smallest = known.groupBy("root").agg(F.min("_id").alias("component_id"))
    table = known.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(table, "fp").select("row", "_id", "fp", "root", "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of every class: the one with the smallest id (one of them if rows repeat it)."""
    c = near_classes(docs, doc_id=doc_id, **options).where(F.col("_id").eqNullSafe(F.col("component_id")))
    return c.dropDuplicates(["root"]).select("row.*")
