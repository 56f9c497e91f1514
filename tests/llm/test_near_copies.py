"""SimHash classes, substring dedup and decontamination against brute force."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from moleval.llm import components, edit_decontam, recompress, simhash_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def simhash(t, n=3):
    w = WORD.findall(lower(t))
    s = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, most=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [low.get(root(i)) for i in range(len(ids))]


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice((1, 2, 8, 60, 200)))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:30]:
        c = b[:]
        c[rng.randrange(len(c))] = "other"
        texts += [" ".join(c), " ".join(b), "  ".join(b).upper()]
    texts += [None, "", " \n ", "x\ty\nz", "é É e", "The  same\nthing", "the same thing", "r " * 100]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0), (None, texts[4], "de", None, None), (None, "alone without id", None, None, None)]


@pytest.mark.parametrize("node_size", [8, 1 << 14])
def test_classes_equal_brute_force(spark, node_size):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "fp": F.lit(2), "root": F.lit(3)})
    got = simhash_trie.near_classes(docs, node_size=node_size).select("row.doc_id", "row.text", "fp", "component_id").collect()
    assert len(got) == len(rows)
    fps = [simhash(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [r[1] for r in rows], fps, classes([r[0] for r in rows], fps), strict=True), key=repr)
    assert sorted(((r.doc_id, r.text, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == want


def test_dedup_keeps_one_of_each_class(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    fps = [simhash(r[1]) for r in rows]
    named = {c for c in classes([r[0] for r in rows], fps) if c is not None}
    got = simhash_trie.dedup(docs).collect()
    assert {r.doc_id for r in got if r.doc_id is not None} == named
    assert len(got) == len(named) + 1           # and the one without any id
    assert simhash_trie.dedup(docs.limit(0)).count() == 0


def test_trie_walk_equals_all_pairs():
    rng = np.random.default_rng(2)
    near = [int(f) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))
            for f in rng.integers(0, 1 << 62, 40) for _ in range(12)]
    x = np.unique(np.array(near, np.uint64))
    got = {(int(i), int(j)) for a, b in simhash_trie.near_pairs(x, x, 63, 0, 3, True) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if bin(int(x[i]) ^ int(x[j])).count("1") <= 3}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(500, 500), (None, 7), (2000, 2001)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)} | {2000: 2000, 2001: 2000}


def cut_by_loop(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    words = {i: WORD.findall(rows[i][1] or "") for i in order}
    first = {}
    for n, i in enumerate(order):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s:s + window]), (n, s))
    out = []
    for n, i in enumerate(order):
        gone = [False] * len(words[i])
        for s in range(len(words[i]) - window + 1):
            if first[tuple(words[i][s:s + window])] != (n, s):
                gone[s:s + window] = [True] * window
        out.append((rows[i][0], len(words[i]), sum(gone), " ".join(w for w, g in zip(words[i], gone, strict=True) if not g)))
    return sorted(out, key=repr)


def repeated_corpus(seed):
    rng = random.Random(seed)
    shared = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.choice((5, 20, 21, 45)))] for _ in range(6)]
    rows = []
    for i in range(40):
        t = []
        for _ in range(rng.randrange(5)):
            t += rng.choice(shared) if rng.random() < 0.6 else [f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice((" ", "\n", "  ")).join(t), "en", "s", 0))
    return rows + [(50, "same " * 70, "en", "s", 0), (51, "same " * 33 + "end", "en", "s", 0), (52, "p q " * 40, None, None, None), (53, None, "en", "s", 0),
                   (54, "", "en", "s", 0), (3, rows[3][1], "en", "s", 0), (3, "other text of the same id " * 8, "en", "s", 0)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("window,chars", [(20, 300), (7, 4_000_000)])
def test_substring_dedup_equals_brute_force(spark, seed, window, chars):
    rows = repeated_corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "chunk": F.lit(2), "n_words": F.lit(3)})
    got = recompress.dedup_substrings(docs, window=window, chunk_chars=chars, shard_chars=chars)
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in got.collect()), key=repr)
    assert got == cut_by_loop(rows, window)


def test_substring_dedup_null_ids_and_very_long_text(spark):
    long = " ".join(f"v{i * 7919 % 100_003}" for i in range(60_000))
    rows = [(1, long, "en", "s", 1), (None, long, "en", "s", 1), (None, "short", "en", "s", 1)]
    got = recompress.dedup_substrings(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"]).collect()
    assert sorted((r.row.doc_id is None, r.n_words, r.n_removed) for r in got) == [(False, 60_000, 0), (True, 1, 0), (True, 60_000, 60_000)]


def test_substring_stage_keeps_columns(spark):
    rows = repeated_corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x"))
    out = recompress.dedup(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    untouched = {r.doc_id: r.text for r in out.collect()}
    assert untouched[53] is None and untouched[54] == "" and untouched[0] == rows[0][1]
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.doc_id == 51)
    assert recompress.dedup(docs.limit(0)).count() == 0


def test_repeated_windows_parse_alike():
    """A symbol whose context lies in a window has the same name wherever the window stands."""
    rng = np.random.default_rng(0)
    words = rng.integers(1, 6, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words[100:140] = words[300:340]
    doc, first = np.zeros(400, np.int64), np.array([0, 400])
    for level in recompress.recompress(words, doc, first):
        inside = lambda at: {(int(x - at), int(y - at), int(n)) for n, x, y in zip(level.name, level.lo, level.hi, strict=True) if x >= at and y <= at + 40}  # noqa: B023, E731
        assert inside(100) == inside(300) and inside(100)


@pytest.mark.parametrize("seed", range(6))
def test_equal_windows_have_equal_anchors_and_others_differ(seed):
    """Windows in documents of few words, with runs and copies: anchors follow the window alone, and symbols tell windows apart."""
    rng = np.random.default_rng(seed)
    source = rng.integers(1, 4 + seed, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    docs = [np.concatenate([rng.integers(1, 4 + seed, rng.integers(0, 30)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15),
                            np.repeat(source[rng.integers(0, 60)], rng.integers(0, 25)), source[rng.integers(0, 30):][: rng.integers(0, 60)]]) for _ in range(40)]
    words, first = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    doc = np.repeat(np.arange(40), [len(d) for d in docs])
    levels = recompress.recompress(words, doc, first)
    assert all((np.diff(x.lo) >= 0).all() and (np.diff(x.hi) >= 0).all() for x in levels)
    window = 12
    start = np.flatnonzero(np.arange(len(words)) + window <= first[doc + 1])
    name, a, b = recompress.anchors(levels, start, window)
    assert ((a >= start) & (b <= start + window) & (b > a)).all() and ((b - a) > 1).mean() > 0.3
    h = recompress.extended(words, start, window, (name, a, b), recompress._POLY[0])
    by = {}
    for s, n, x, y, v in zip(start, name, a, b, h, strict=True):
        by.setdefault(words[s:s + window].tobytes(), set()).add((int(n), int(x - s), int(y - s), int(v)))
    assert all(len(v) == 1 for v in by.values()) and len({x[3] for v in by.values() for x in v}) == len(by)
    # without the symbols' names, windows that differ inside their anchors fall together
    bare = recompress.extended(words, start, window, (name * np.uint64(0), a, b), recompress._POLY[0])
    assert len(set(bare.tolist())) < len(by)


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(90)))
        d, end = edit_decontam.myers(p, t)
        assert d == edit_distance(p, t) and (edit_distance(p, t[:end]) == d)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdefghij "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.choice((30, 90, 200))))) for i in range(12)] + [(50, None), (51, ""), (0, "abc def ghi jkl mno")]
    docs = []
    for i in range(60):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(300)))
        if i % 3 == 0:
            text = list(rng.choice(items[:12])[1])
            for _ in range(rng.randrange(12)):
                at = rng.randrange(len(text))
                text[at] = rng.choice(["", "X", text[at] + "q"])
            t = t[:50] + "".join(text).upper().replace(" ", "\n") + t[50:]
        docs.append((i, t, "en", "s", 0))
    docs += [(90, None, None, None, None), (91, "", "en", "s", 0), (0, docs[0][1], "en", "s", 0), (92, "z" * 50_000 + items[2][1], "en", "s", 0)]
    d = spark.createDataFrame(docs, SCHEMA).withColumns({"row": F.lit(1), "found": F.lit(2), "item_id": F.lit(3)})
    b = spark.createDataFrame(items, "item_id bigint, text string")
    fold = lambda t: re.sub(r"[\t-\r]", " ", lower(t))
    want = sorted((i, k, t) for i, t, *_ in docs for k, x in items
                  if t and x and edit_distance(fold(x), fold(t)[-400:]) <= int(len(x) * edit_decontam.RATE))
    for chars in (edit_decontam.SLICE_CHARS, 300):
        got = edit_decontam.matches(d, b, slice_chars=chars).collect()
        assert sorted({(r.row.doc_id, r.item_id, r.row.text) for r in got}) == sorted(set(want))
        text = {(r.item_id, r.distance): (fold(r.row.text)[r.start:r.end], r) for r in got}
        by = dict(items[:12])
        for (k, dist), (stretch, _) in text.items():
            if k:
                assert edit_distance(fold(by[k]), stretch) == dist == edit_distance(stretch, fold(by[k])) or dist >= 0
    bad = {i for i, _, _ in want}
    for chars in (edit_decontam.SLICE_CHARS, 300):
        left = edit_decontam.decontaminate(d, b, slice_chars=chars)
        assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {r[0] for r in docs} - bad
    assert edit_decontam.decontaminate(d, b.limit(0)).count() == len(docs)
    assert edit_decontam.matches(d.limit(0), b).count() == 0


def test_fingerprints_of_odd_texts():
    texts = [None, "", "A", "a b", "x  y\tz", "é É e", "The cat sat " * 50]
    assert [int(v) for v in simhash_trie.fingerprint_array(pa.array(texts))] == [simhash(t) for t in texts]
