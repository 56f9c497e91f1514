"""Phrase mining against plain counting, with split leads, small partitions and odd texts."""
import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from moleval.llm import phrases


def plain_counts(rows, max_words):
    """{(group, words): count} and {group: words} of (text, group) rows."""
    f, n = collections.Counter(), collections.Counter()
    for text, g in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g or "und" if g is None else g] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[g if g is not None else "und", tuple(w[i:i + k])] += 1
    return f, n


def plain_top(rows, max_words=3, min_count=10, covered=50, top=2000):
    f, n = plain_counts(rows, max_words)
    cand = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= min_count}
    out = collections.defaultdict(list)
    for (g, w), a in cand.items():
        if any(h == g and len(v) > len(w) and 100 * b >= covered * a and any(v[i:i + len(w)] == w for i in range(len(v))) for (h, v), b in cand.items()):
            continue
        s, _, left, right = min((1_000_000 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
        out[g].append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((g, i, p.decode(), -a, left, right, n[g], -s) for g, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def mined(spark, rows, max_words=3, min_count=10, covered=50, top=2000, **kw):
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("g", "phrase", "k", "n")}).repartition(3)
    frequent = phrases.frequent_phrases(df, max_words=max_words, min_count=min_count, **kw)
    got = phrases.top_phrases(phrases.collocations(frequent, covered), top)
    return sorted(map(tuple, got.select("g", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "new", "CITY", "a", "b", "ß", "é", "Ωmega"] + [f"w{i}" for i in range(25)]
    def text():
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(words) if rng.random() < 0.6 else rng.choice(["of the", "new York City", "the  of\tthe", "a,b", "a. b"]))
            out.append(rng.choice([" ", " ", " ", " ", "  ", "\n", ", ", ".", "\t", "\r\n", "?! "]))
        return "".join(out)
    rows = [(text(), rng.choice(["en", "de", None, "und"])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" \n.", "x"), ("long word " * 3000, "de"), ("x" * 70_000, "de")] + [("exact copy of a text", "en")] * 15


@pytest.mark.parametrize("kw", [{}, {"bucket": 60, "leads": 1 << 16}, {"bucket": 20}])
def test_phrases_equal_plain_counts(spark, kw):
    rows = corpus(1)
    assert mined(spark, rows, **kw) == plain_top(rows)


def test_longer_phrases_and_fewer_ranks(spark):
    rows = corpus(2, 60)
    assert mined(spark, rows, max_words=5, min_count=4, covered=80, top=7, bucket=100) == plain_top(rows, 5, 4, 80, 7)


def test_leads_are_split_and_meet_again(spark):
    """One pair leads nearly all suffixes: its buckets are many, its counts whole."""
    rows = [(" ".join(f"hot pair z{(i * 7 + j) % 40}" for j in range(30)), "en") for i in range(60)]
    texts = spark.createDataFrame(rows, "text string, g string").select("g", "text")
    how = phrases.routes(texts, 3, bucket=16)
    assert len(how.split[0][0]) and len(how.split[1][0]) and how.split[1][1].max() > 1
    assert mined(spark, rows, bucket=16) == plain_top(rows)


@pytest.mark.parametrize("seed", range(4))
def test_three_way_quicksort_equals_counting(seed):
    rng = np.random.default_rng(seed)
    n = 3000
    keys = [np.minimum(rng.geometric(0.05 * (seed + 1), n), 40).astype(np.int64), rng.integers(-1, 6, n), rng.integers(-1, 9, n)]
    keys[2][keys[1] < 0] = -1
    many = rng.integers(1, 4, n)
    level = np.where(keys[0] < 3, 1, 0).astype(np.uint8)
    for small in (4, 100, 1 << 13):
        found = phrases.equal_partitions(keys, many, level, 9, small)
        for d, (p, sums) in enumerate(found):
            want = collections.Counter()
            for i in range(n):
                if all(k[i] >= 0 for k in keys[:d + 1]):
                    want[tuple(int(k[i]) for k in keys[:d + 1])] += int(many[i])
            frequent = lambda t: all(want_of(keys, many, t[:j + 1]) >= 9 or (j == 0 and t[0] < 3) for j in range(len(t)))
            assert {tuple(int(k[i]) for k in keys[:d + 1]): int(s) for i, s in zip(p, sums)} == {t: c for t, c in want.items() if frequent(t)}


def want_of(keys, many, t):
    at = np.ones(len(many), bool)
    for k, v in zip(keys, t):
        at &= k == v
    return many[at].sum()


def test_empty_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("", "en")]) == []
