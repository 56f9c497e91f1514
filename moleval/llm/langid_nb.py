"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is one space between words; 1- to
3-grams are hashed to ``2**BITS`` buckets.  Counts per (language, bucket) are
taken over all learning documents in Spark; the log-probability matrix
(buckets x languages, at most ``MAX_MODEL_BYTES``) is broadcast, and a block of
documents is scored as a sparse count matrix times it.

Null texts and texts without a letter are ``und`` with score 0; rows with a
null language are not learned from; without any learning row every text is
``und``; equal scores go to the first language by name; repeated rows count as
often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from moleval.llm.chargrams import code_points, counted, grams, letters
from moleval.llm.words import blocks

BITS = 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
PARTS = 16                      # pieces of the bucket range: a language's sums are added in several tasks
MAX_MODEL_BYTES = 256 << 20
UNKNOWN = "und"


def letter_grams(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse (document, bucket, count) of a block of texts."""
    cp, off = code_points(pc.utf8_lower(texts.fill_null("")))
    if not len(cp):
        z = np.zeros(0, np.int64)
        return z, z, z
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    letter = letters()[cp]
    before = np.concatenate(([False], letter[:-1] & (doc[1:] == doc[:-1])))
    keep = letter | before
    return counted(*grams(np.where(letter, cp, np.uint32(32))[keep], doc[keep], ORDERS, bits, skip=32), bits)


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS) -> DataFrame:
    """(lang, part, counts): packed sums of the n-gram counts of all documents with a language."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << bits, np.int64))
        for b in blocks(batches, "text"):
            doc, bucket, n = letter_grams(b.column(0), bits)
            codes = b.column(1).dictionary_encode()
            of = codes.indices.to_numpy(zero_copy_only=False)[doc]
            for k, name in enumerate(codes.dictionary.to_pylist()):
                mine = of == k
                sums[name] += np.bincount(bucket[mine], n[mine], 1 << bits).astype(np.int64)
        rows = [(name, p, x.tobytes()) for name, v in sums.items() for p, x in enumerate(np.split(v, PARTS))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "part", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) // PARTS, np.int64)
        for b in batches:
            for x in b.column(2).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "part": pa.array([key[1].as_py()], "int64"), "counts": [total.tobytes()]})

    d = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    kind = "lang string, part bigint, counts binary"
    return d.mapInArrow(local, kind).groupBy("lang", "part").applyInArrow(add, kind)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS,
        smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the log probability of each bucket in each of them."""
    counts = count_grams(docs, text, lang, bits)
    by: dict[str, dict[int, bytes]] = defaultdict(dict)
    for r in counts.toLocalIterator():
        by[r.lang][r.part] = r.counts
        if (len(by) << bits) * 4 > MAX_MODEL_BYTES:
            raise ValueError(f"too many languages for a model of {MAX_MODEL_BYTES} bytes; lower bits")
    names = sorted(by)
    matrix = np.zeros((1 << bits, len(names)), np.float32)
    for k, name in enumerate(names):
        c = np.frombuffer(b"".join(by[name][p] for p in range(PARTS)), np.int64) + smoothing
        matrix[:, k] = np.log(c / c.sum())
    return names, matrix


def classify(texts: pa.Array, names: list[str], matrix: np.ndarray, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Most likely language of each text and its posterior under equal priors."""
    doc, bucket, n = letter_grams(texts, bits)
    total = np.zeros((len(texts), len(names)))
    if len(doc) and names:
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        total[doc[first]] = np.add.reduceat(matrix[bucket] * n[:, None].astype(np.float64), first, axis=0)
    known = np.zeros(len(texts), bool)
    known[doc] = bool(names)
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = total.argmax(1)
    score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def language(text: Column, spark, model: tuple[list[str], np.ndarray]) -> Column:
    """struct<lang_pred, score> of a text column."""
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, matrix = sent.value
        bits = len(matrix).bit_length() - 1
        for a in batches:
            labels, scores = [], [np.zeros(0)]
            for b in blocks([pa.RecordBatch.from_arrays([a], ["t"])], "t"):
                x, s = classify(b.column(0), names, matrix, bits)
                labels += x
                scores.append(s)
            yield pa.StructArray.from_arrays([pa.array(labels, "string"), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    return identify(text)
