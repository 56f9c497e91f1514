"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed character 1- to 3-grams (``2**BITS`` buckets) and three
shares: words equal to their predecessor, words in repeated five-word windows,
and distinct words.  Term weights are square roots of shares times inverse
document frequency; a truncated singular value decomposition of the labelled
sample's term matrix gives ``RANK`` latent axes.

The labelled sample has ``MAX_REFERENCES`` rows at most (smallest hash of the id
first) - the bound of what is broadcast: the axes and the sample's unit vectors
and labels.  Every document is projected, its cosine with every reference is
one block of a matrix product, and the ``NEIGHBOURS`` nearest vote with their
label, weighted by a power of the similarity.

Null and empty texts have the zero vector: every neighbour weighs nothing and
the score is the sample's share of label 1 (0.5 without any label); null labels
are not learned from; ties at the last neighbour fall to the earlier reference;
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

from moleval.llm.chargrams import code_points, grams
from moleval.llm.sampling import labelled_sample
from moleval.llm.words import Words, blocks, mix

BITS = 12
ORDERS = (1, 2, 3)
EXTRA = 3
EXTRA_WEIGHT = 0.7
RANK = 48
MAX_REFERENCES = 4096
NEIGHBOURS = 25
POWER = 4
ROWS = 128                      # documents whose dense term rows are held at once
WINDOW = 5


def repeated_share(w: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: share of words equal to the one before, of windows seen more than
    once, and of distinct words (0 for texts without words)."""
    n = w.counts
    docs = len(n)
    words = np.maximum(n, 1)
    if not len(w):
        return np.zeros(docs), np.zeros(docs), np.zeros(docs)
    h = w.hashes()
    again = np.bincount(w.doc[1:][(h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=docs)

    def repeated(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of values that their text has twice or more, and distinct values."""
        key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (x >> np.uint64(20)))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        twin = ~new
        twin[:-1] |= ~new[1:]
        d = (key >> np.uint64(44)).astype(np.int64)
        return np.bincount(d[twin], minlength=docs), np.bincount(d[new], minlength=docs)

    m = len(h) - window + 1
    runs = np.zeros(docs)
    if m > 0:
        x = h[:m].copy()
        for k in range(1, window):
            x = x * np.uint64(0xD6E8FEB86659FD93) + h[k:k + m]
        inside = w.doc[:m] == w.doc[window - 1:]
        if inside.any():
            runs = repeated(mix(x[inside]), w.doc[:m][inside])[0]
    return again / words, runs / words, repeated(h, w.doc)[1] / words * (n > 0)


def term_rows(texts: pa.Array, bits: int = BITS) -> np.ndarray:
    """Dense term weights (before inverse document frequency) of a few texts."""
    size = 1 << bits
    out = np.zeros((len(texts), size + EXTRA), np.float32)
    cp, off = code_points(texts)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    d, bucket = grams(cp, doc, ORDERS, bits)
    counts = np.bincount(d * size + bucket, minlength=len(texts) * size).reshape(len(texts), size)
    out[:, :size] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    out[:, size:] = EXTRA_WEIGHT * np.sqrt(np.stack(repeated_share(Words(texts)), 1))
    return out


def _small(batches, text: str) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, text, 512 << 10):
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


class Model:
    """Inverse document frequencies, latent axes, unit reference vectors and labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS, power: float = POWER):
        n, size = rows.shape
        grams_ = size - EXTRA
        df = (rows[:, :grams_] > 0).sum(0)
        self.idf = np.concatenate((np.log((n + 1) / (df + 1)) + 0.1, np.ones(EXTRA))).astype(np.float32)
        self.bits = grams_.bit_length() - 1
        x = rows * self.idf
        if not n:
            self.axes, self.references, self.labels = np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), labels
            self.prior, self.neighbours, self.power = 0.5, 0, power
            return
        # randomised subspace iteration; the seed is fixed, so reruns agree
        k = max(1, min(rank, n, size))
        q = np.random.default_rng(0).standard_normal((size, min(k + 16, size))).astype(np.float32)
        for _ in range(5):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.axes = (q @ vt.T)[:, :k].astype(np.float32)
        self.references = self.unit(x @ self.axes)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean())
        self.neighbours, self.power = min(neighbours, n), power

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.neighbours:
            return np.full(len(texts), self.prior)
        v = self.unit((term_rows(texts, self.bits) * self.idf) @ self.axes)
        cos = v @ self.references.T
        if self.neighbours < cos.shape[1]:
            near = np.argpartition(-cos, self.neighbours - 1, axis=1)[:, :self.neighbours]
        else:
            near = np.broadcast_to(np.arange(cos.shape[1]), cos.shape)
        weight = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** self.power
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1)
        return np.clip(np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", doc_id: str = "doc_id", bits: int = BITS,
        max_references: int = MAX_REFERENCES, **options) -> Model:
    """Model of a bounded sample of the labelled documents; their term rows are made in Spark."""
    sample = labelled_sample(docs, labels, max_references, doc_id, text, label)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, "text"):
            x = term_rows(b.column(0), bits).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], "binary"), b.column(1), b.column(2)], ["x", "label", "h"])

    got = sample.mapInArrow(rows, "x binary, label int, h bigint").collect()
    got.sort(key=lambda r: (r.h, r.x, r.label))
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(len(got), (1 << bits) + EXTRA)
    return Model(x, np.array([r.label for r in got], np.float64), **options)


def quality(text: Column, spark, model: Model) -> Column:
    """Score (0 to 1) of a text column."""
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for a in batches:
            parts = [m.scores(b.column(0)) for b in _small([pa.RecordBatch.from_arrays([a], ["t"])], "t")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return vote(text)
