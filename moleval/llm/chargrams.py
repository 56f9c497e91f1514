"""Hashed character n-grams of whole texts as sparse (document, bucket, count) arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from moleval.llm.words import _offsets, run_starts

_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter (one table per Python worker)."""
    if not _letter:
        _letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letter[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each text starts (n + 1)."""
    off, buf = _offsets(texts)
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, lead[off]


def grams(cp: np.ndarray, doc: np.ndarray, orders: tuple, bits: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram inside a document; a 1-gram of ``skip`` is left out."""
    docs, buckets = [], []
    for n in orders:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32) * _MULT[3]
        for k in range(n):
            h = (h ^ cp[k:k + m]) * _MULT[k % 3]
            h ^= h >> np.uint32(15)
        ok = doc[:m] == doc[n - 1:]
        if n == 1 and skip is not None:
            ok &= cp[:m] != skip
        docs.append(doc[:m][ok])
        buckets.append((h * _MULT[3] >> np.uint32(32 - bits))[ok])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs).astype(np.int64), np.concatenate(buckets).astype(np.int64)


def counted(doc: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs in order, with their counts."""
    key = np.sort((doc << bits) | bucket)
    at = run_starts(key)
    return key[at] >> bits, key[at] & ((1 << bits) - 1), np.diff(np.concatenate((at, [len(key)])))
