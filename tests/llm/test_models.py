"""Learned operators: exact against brute force where that exists, else by held-out accuracy."""
import collections
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moleval.llm import crf_toxicity, kn_lm, knn_quality, langid_nb, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
ODD = [(100001, None, None), (100002, "", "en"), (100003, "A a A", "en"), (100003, "A a A", "en"), (None, "123 !?", "de"), (100005, "x " * 30_000, None)]


def odd(spark, *names):
    d = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string")
    return d.withColumns({n: F.lit(1) for n in names})


def tokens(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


class PlainModel:
    """Kneser-Ney with dictionaries."""

    def __init__(self, texts, order):
        self.n = [None] + [collections.Counter() for _ in range(order)]
        self.raw, self.order = collections.Counter(), order
        for t in texts:
            x = ["<s>", *tokens(t), "</s>"]
            self.raw.update(x[1:])
            for i in range(1, len(x)):
                if i >= order - 1:
                    self.n[order][tuple(x[i - order + 1:i + 1])] += 1
                elif i > 0:
                    self.n[i + 1][tuple(x[:i + 1])] += 1
        for k in range(order, 1, -1):
            for g in list(self.n[k]):
                self.n[k - 1][g[1:]] += 1
        self.d = [None]
        self.context = [None]
        for k in range(1, order + 1):
            times = collections.Counter(self.n[k].values())
            self.d.append((0, *kn_lm._discounts([times[i] for i in (1, 2, 3, 4)])))
            c = collections.defaultdict(lambda: [0, 0, 0, 0])
            for g, v in self.n[k].items():
                c[g[:-1]][0] += v
                c[g[:-1]][min(v, 3)] += 1
            self.context.append(c)

    def p(self, g):
        k = len(g)
        low = self.p(g[1:]) if k > 1 else 1 / (len(self.n[1]) + 1)
        c = self.context[k].get(g[:-1])
        if not c:
            return low
        v, d = self.n[k].get(g, 0), self.d[k]
        return (max(v - d[min(v, 3)], 0) + sum(d[i] * c[i] for i in (1, 2, 3)) * low) / c[0]

    def row(self, t):
        x = ["<s>", *tokens(t), "</s>"]
        n, v = sum(self.raw.values()), len(self.raw)
        return (len(x) - 1, sum(self.raw[w] > 0 for w in x[1:]), sum(math.log10((self.raw[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x[1:]),
                sum(math.log10(self.p(tuple(x[max(0, i - self.order + 1):i + 1]))) for i in range(1, len(x))))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_equals_plain_counts(spark, order):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    rows = docs.collect()
    learn = docs.where("doc_id % 5 <> 1")
    model = kn_lm.fit(learn, order=order, shard_chars=20_000)
    plain = PlainModel([r.text for r in learn.collect()], order)
    got = sorted((r.i, *r.x) for r in docs.select(F.coalesce("doc_id", F.lit(-1)).alias("i"), kn_lm.scores(F.col("text"), spark, model).alias("x")).collect())
    want = sorted((-1 if r.doc_id is None else r.doc_id, *plain.row(r.text)) for r in rows)
    assert model.tokens == sum(plain.raw.values())
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)
    if order == 2:          # the probabilities after a word, with the unknown one, add up to 1
        some = next(iter(plain.context[2]))[0]
        assert sum(plain.p((some, w)) for w in (g[0] for g in plain.n[1])) + plain.p((some, "never seen")) == pytest.approx(1)


def test_language_model_fails_without_a_shard(spark):
    docs = spark.createDataFrame([(f"a b c d{i} e",) for i in range(30)], "text string")
    model = kn_lm.fit(docs)
    assert model.uri.startswith("file:") and {k for k, _ in model.stored} == {0, 1, 2, 3}
    import os
    folder = "/" + model.uri.removeprefix("file:").lstrip("/")
    os.rename(f"{folder}/gram3-0.key", f"{folder}/elsewhere")
    kn_lm._shard.cache_clear()
    with pytest.raises(Exception, match="gram3-0.key"):
        docs.select(kn_lm.scores(F.col("text"), spark, model)["score"]).collect()


def test_language_model_without_rows(spark):
    model = kn_lm.fit(odd(spark).limit(0))
    got = odd(spark).select(kn_lm.scores(F.col("text"), spark, model)["score"].alias("s")).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.s) for r in got)
    assert odd(spark).limit(0).select(kn_lm.scores(F.col("text"), spark, model)).count() == 0


def accuracy(spark, name, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = queries.QUERIES[name](spark, SF).where("held_out").join(labels, "doc_id").groupBy(label, "predicted").count().collect()
    n = {(x[label], x.predicted): x["count"] for x in r}
    return n.get((1, 1), 0) / max(1, n.get((1, 1), 0) + n.get((1, 0), 0)), n.get((0, 0), 0) / max(1, n.get((0, 0), 0) + n.get((0, 1), 0))


def test_quality_held_out_accuracy(spark):
    good, junk = accuracy(spark, "op5_knn_quality", "quality")
    assert good >= 0.95 and junk >= 0.7


def test_toxicity_held_out_accuracy(spark):
    toxic, clean = accuracy(spark, "op9_crf_toxicity", "toxic")
    assert toxic >= 0.5 and clean >= 0.97


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = queries.op6_langid_nb(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_votes_equal_a_full_sort():
    rng = np.random.default_rng(0)
    texts = pa.array([" ".join(rng.choice(["alpha", "beta", "gamma$$", "DELTA!!"], rng.integers(1, 40))) for _ in range(90)] + ["", None])
    rows = knn_quality.term_rows(texts)
    model = knn_quality.Model(rows[:60], (np.arange(60) % 3 > 0).astype(float), rank=8, neighbours=7)
    got = model.scores(texts)
    v = model.unit((rows * model.idf) @ model.axes)
    for i in range(90):
        cos = model.references @ v[i]
        near = sorted(range(60), key=lambda j: -cos[j])[:7]
        w = np.maximum(cos[near], 0).astype(float) ** model.power
        assert got[i] == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-4)
    assert got[90] == got[91] == pytest.approx(model.prior)


def test_quality_of_odd_rows_and_without_labels(spark):
    docs = odd(spark, "x", "h")
    model = knn_quality.fit(docs, docs.select("doc_id", F.when(F.col("doc_id") == 100003, 1).alias("label")))
    assert [0 <= r.s <= 1 for r in docs.select(knn_quality.quality(F.col("text"), spark, model).alias("s")).collect()] == [True] * len(ODD)
    none = knn_quality.fit(docs, docs.select("doc_id", F.lit(None).cast("int").alias("label")))
    assert {r.s for r in docs.select(knn_quality.quality(F.col("text"), spark, none).alias("s")).collect()} == {0.5}
    assert docs.limit(0).select(knn_quality.quality(F.col("text"), spark, none)).count() == 0


def test_language_counts_and_odd_rows(spark):
    docs = odd(spark, "part", "counts").union(spark.createDataFrame([(7, "Ñandú été", "es", 1, 1), (8, "über Größe", "de", 1, 1)], "a long, b string, c string, d int, e int"))
    model = langid_nb.fit(docs)
    assert model[0] == ["de", "en", "es"]
    got = [(r.text, r.x.lang_pred, r.x.score) for r in docs.select("text", langid_nb.language(F.col("text"), spark, model).alias("x")).collect()]
    by = {t: (p, s) for t, p, s in got}
    assert by[None] == by[""] == by["123 !?"] == ("und", 0.0)
    assert by["A a A"][0] == "en" and by["Ñandú été"][0] == "es" and by["über Größe"][0] == "de"
    empty = langid_nb.fit(docs.limit(0))
    assert {r.x.lang_pred for r in docs.select(langid_nb.language(F.col("text"), spark, empty).alias("x")).collect()} == {"und"}
    # the counts are those of a loop over letters and single spaces between words
    doc, bucket, n = langid_nb.letter_grams(pa.array(["Ab,  c!", None, "É"]))
    assert n[doc == 0].sum() == sum(len([g for g in ("".join(x) for x in zip(*("ab c "[k:] for k in range(size)))) if g != " "]) for size in (1, 2, 3))
    assert n[doc == 2].sum() == 1


@pytest.mark.parametrize("lengths", [[1], [5], [3, 1, 6, 2]])
def test_field_marginals_equal_enumeration(lengths):
    rng = np.random.default_rng(sum(lengths))
    n = sum(lengths)
    e, t = rng.normal(size=n), rng.normal(size=(2, 2))
    chain = np.cumsum(lengths) - np.array(lengths)
    p = crf_toxicity.sigmoid(crf_toxicity.marginals(e, chain, t))
    inner = np.setdiff1d(np.arange(n), chain)
    pair = crf_toxicity.pair_marginals(e, chain, t, inner)
    for a, size in zip(chain, lengths, strict=True):
        weight = {y: math.exp(sum(e[a + i] * v for i, v in enumerate(y)) + sum(t[u, v] for u, v in itertools.pairwise(y)))
                  for y in itertools.product((0, 1), repeat=size)}
        z = sum(weight.values())
        for i in range(size):
            assert p[a + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)
            if i:
                at = int(np.flatnonzero(inner == a + i)[0])
                for u in (0, 1):
                    for v in (0, 1):
                        assert pair[u][v][at] == pytest.approx(sum(w for y, w in weight.items() if y[i - 1] == u and y[i] == v) / z)


def toxic_table(spark):
    plain = ["an", "old", "tree", "sat", "there", "nothing", "else", "here", "words", "really", "you"]
    rows = [(i, " ".join(plain[(i * k) % 11] for k in range(1, 9)) + ".\nAnd " + plain[i % 11] + (" Idiot! " if i % 4 == 0 else " ") + plain[i * 3 % 11],
             int(i % 4 == 0)) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


def test_spans_mark_the_words(spark):
    model = crf_toxicity.fit(toxic_table(spark).drop("label"), toxic_table(spark))
    text = "Ünder the tree,\nan \"IDIOT\" sat. Nothing else"
    got = spark.createDataFrame([(text,), ("plain words stand here",), (None,), ("",)], "text string").select(
        "text", crf_toxicity.toxicity(F.col("text"), spark, model).alias("x")).collect()
    assert [text[s.start:s.end] for s in got[0].x.spans] == ["IDIOT"] and got[0].x.score > 0.7
    assert all(r.x.score < 0.3 and not r.x.spans for r in got[1:])
    assert got[2].x.score == got[3].x.score


def test_toxicity_of_odd_rows_and_without_labels(spark):
    docs = odd(spark, "x", "h")
    model = crf_toxicity.fit(docs, docs.select("doc_id", F.lit(None).cast("int").alias("label")))
    assert all(r.s < 0.01 for r in docs.select(crf_toxicity.toxicity(F.col("text"), spark, model)["score"].alias("s")).collect())
    one = crf_toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("label")))
    assert all(r.s > 0.99 for r in docs.select(crf_toxicity.toxicity(F.col("text"), spark, one)["score"].alias("s")).collect())
    assert docs.limit(0).select(crf_toxicity.toxicity(F.col("text"), spark, one)).count() == 0


def test_registered_language_model_looks_at_two_words(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "d b e", "a b c", "d b e"] * 20)], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_kn_lm(spark, str(tmp_path)).collect()}
    learn = [r.text for r in docs.join(spark.createDataFrame([(i,) for i, r in got.items() if not r.held_out], "doc_id bigint"), "doc_id").collect()]
    plain = PlainModel(learn, 3)
    assert got[0].score == pytest.approx(plain.row("a b c")[3], rel=1e-9)
    assert plain.p(("a", "b", "c")) > 2 * plain.p(("d", "b", "c"))


def test_packed_grams_and_counts_come_back(tmp_path):
    rng = np.random.default_rng(3)
    for k, n in ((1, 50), (3, 4000), (5, 20_000)):
        columns = [rng.integers(0, 2**64, n, np.uint64) for _ in range(k)]
        counts = rng.integers(1, 2**40, n)
        parts = [kn_lm._unpack(d) for d in kn_lm._pack(columns, counts)]
        assert sorted(zip(*[np.concatenate(c).tolist() for c in zip(*parts, strict=True)], strict=True)) == sorted(zip(*[c.tolist() for c in columns], counts.tolist(), strict=True))
    stats = rng.integers(0, 2**40, (30, 4)) >> rng.integers(0, 40, (30, 4))
    kn_lm.Store(str(tmp_path)).write_counts("x", stats)
    at = np.array([29, 0, 7, 7])
    assert (kn_lm._counts(str(tmp_path), "x", 4, at) == stats[at]).all()
    kn_lm.Store(str(tmp_path)).write_counts("y", stats[:, 0])
    assert (kn_lm._counts(str(tmp_path), "y", 1, at) == stats[at, 0]).all()


def test_field_learns_from_every_token_of_the_sample(spark):
    texts = [("calm " * 500 + "Idiot\nthe end " * 30, 1), ("a plain line\n" * 200 + "last", 0), ("nothing marked here", 1), ("", 0)]
    sample = spark.createDataFrame(texts, "text string, label int")
    t = crf_toxicity.Tokens(pa.array(["idiot"]))
    marks = spark.sparkContext.broadcast(np.sort(t.hashes()[:1, 0]))
    rows = crf_toxicity._training_lines(sample, marks).collect()
    lines = [x.split() for text, _ in texts for x in text.split("\n") if x.split()]
    assert sorted(len(r.y) for r in rows) == sorted(map(len, lines))
    assert sum(sum(r.y) for r in rows) == 30
    assert all(len(r.x) == 4 * (crf_toxicity.FEATURES + 2) * len(r.y) for r in rows)


def test_every_line_is_in_one_batch(monkeypatch):
    monkeypatch.setattr(crf_toxicity, "BATCH_TOKENS", 10)
    monkeypatch.setattr(crf_toxicity, "CHUNK_BYTES", 900)
    width = crf_toxicity.FEATURES + 2
    lines = [(np.full(n * width, i, np.int32).tobytes(), bytes(n)) for i, n in enumerate([3, 9, 25, 1, 4, 4, 2, 30, 8])]
    got = [[(int(x[0, 0]), len(y)) for x, y in batch] for batch in crf_toxicity._batches(iter(lines), np.random.default_rng(0))]
    assert sorted(g for b in got for g in b) == [(i, len(y)) for i, (_, y) in enumerate(lines)]
    assert all(len(b) == 1 or sum(n for _, n in b) <= 10 for b in got)


def test_language_model_takes_little_room(spark):
    """Less than 8 bytes a triple, its context's share included; hash keys alone take more."""
    rng = np.random.default_rng(5)
    texts = [(" ".join(f"w{i}" for i in row),) for row in np.minimum(rng.zipf(1.2, (400, 100)), 30_000)]
    model = kn_lm.fit(spark.createDataFrame(texts, "text string"))
    folder = "/" + model.uri.removeprefix("file:").lstrip("/")
    grams = len({tuple(x[i - 2:i + 1]) for t, in texts for x in [["<s>", *t.split(), "</s>"]] for i in range(2, len(x))})
    import os
    room = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith(("gram3", "context3")))
    assert room < 8 * grams


def test_language_model_of_contexts_with_many_words(spark):
    texts = [f"a b w{i}" for i in range(300)] + [f"x{i % 7} b w{i % 90}" for i in range(200)] + ["b w1 w2", "a b", "A B w3"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model, plain = kn_lm.fit(docs, shard_chars=1000), PlainModel(texts, 3)
    asked = [*texts[::20], "a b none", "x1 b w3", "none b w3", "a none w1 w2"]
    got = spark.createDataFrame([(t,) for t in asked], "text string").select("text", kn_lm.scores(F.col("text"), spark, model)["score"].alias("s")).collect()
    assert model.vocabulary.shards > 3
    for r in got:
        assert r.s == pytest.approx(plain.row(r.text)[3], rel=1e-9)


@pytest.mark.parametrize("bits", [5, 21, 40])
def test_shards_answer_for_their_ngrams(tmp_path, bits):
    """Counts and totals of contexts, also where the context's key is a hash and where it has more than 64 n-grams."""
    rng = np.random.default_rng(bits)
    some = rng.integers(1, min(1 << bits, 1 << 39) - 1, 200, np.uint64)
    columns = [some[rng.integers(0, m, 4000)] for m in (6, 40, 200)]
    rows = collections.Counter(zip(*[c.tolist() for c in columns], strict=True))
    at, counts = kn_lm._distinct(columns, [bits] * 3, None)
    columns = [c[at] for c in columns]
    assert dict(zip(zip(*[c.tolist() for c in columns], strict=True), counts.tolist(), strict=True)) == rows
    counts = counts + 250 * (counts > 2)
    times = dict(zip(zip(*[c.tolist() for c in columns], strict=True), counts.tolist(), strict=True))
    key = kn_lm.context_key(columns[:-1], bits)
    s = kn_lm.shard_of(key, kn_lm.key_width(2, bits), 3)
    for i, pick in kn_lm._by_shard(s):
        pick = pick[np.lexsort((columns[2][pick], key[pick]))]
        kn_lm._write_shard(kn_lm.Store(str(tmp_path)), f"gram3-{i}", key[pick], columns[2][pick], counts[pick], bits)
    vocabulary = kn_lm.Vocabulary(str(tmp_path), 3, 1, 1, (1 << bits) - 1, frozenset())
    model = kn_lm.Model(vocabulary, 3, (), (), frozenset((3, int(i)) for i in np.unique(s)))
    ask = [np.concatenate((c, rng.permutation(c))) for c in columns]
    count, stats = model._look_up(ask)
    want = collections.defaultdict(lambda: [0, 0, 0, 0])
    for g, v in times.items():
        want[g[:2]][0] += v
        want[g[:2]][min(v, 3)] += 1
    for g, v, four in zip(zip(*[c.tolist() for c in ask], strict=True), count.tolist(), stats.tolist(), strict=True):
        assert v == times.get(g, 0) and four == want[g[:2]]


@pytest.mark.parametrize("width", [1, 2, 3, 10, 13])
def test_scattered_numbers_are_distinct(width):
    x = kn_lm._scatter(np.arange(1 << width, dtype=np.uint64), width)
    assert sorted(x.tolist()) == list(range(1 << width))


def test_scattered_numbers_come_back():
    rng = np.random.default_rng(2)
    for width in (1, 2, 3, 13, 44, 64):
        x = rng.integers(0, 2**width, 1000, np.uint64)
        assert (kn_lm._unscatter(kn_lm._scatter(x, width), width) == x).all()


def test_a_model_of_many_shards_is_opened_once(tmp_path, monkeypatch):
    """Also where it has more files than one batch of texts could keep open before."""
    shards, bits, rng = 1200, 20, np.random.default_rng(9)
    columns = [np.repeat(rng.integers(1, 1 << bits, 20_000, np.uint64), 2), np.repeat(rng.integers(1, 1 << bits, 20_000, np.uint64), 2), np.tile(np.array([3, 5], np.uint64), 20_000)]
    key = kn_lm.context_key(columns[:-1], bits)
    s = kn_lm.shard_of(key, 2 * bits, shards)
    for i, pick in kn_lm._by_shard(s):
        pick = pick[np.lexsort((columns[2][pick], key[pick]))]
        kn_lm._write_shard(kn_lm.Store(str(tmp_path)), f"gram3-{i}", key[pick], columns[2][pick], np.full(len(pick), 2), bits)
    model = kn_lm.Model(kn_lm.Vocabulary(str(tmp_path), shards, 1, 1, (1 << bits) - 1, frozenset()), 3, (), (), frozenset((3, int(i)) for i in np.unique(s)))
    opened, read = [], kn_lm.Store.read
    monkeypatch.setattr(kn_lm.Store, "read", lambda self, name, *a: opened.append(name) or read(self, name, *a))
    kn_lm._shard.cache_clear()
    for _ in range(2):
        count, stats = model._look_up(columns)
        assert (count == 2).all() and (stats == [4, 0, 2, 0]).all()
    assert len(opened) == len({*opened}) > 4096


def test_texts_scored_together_have_their_own_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).select("text")
    model = kn_lm.fit(docs, shard_chars=20_000)
    texts = [r.text for r in docs.collect()] + [None, "", "not seen before", "x"]
    whole = model.score(*kn_lm.token_rows(pa.array(texts)))
    alone = [model.score(*kn_lm.token_rows(pa.array([t], "string"))) for t in texts]
    for name, v in whole.items():
        assert v.tolist() == pytest.approx([a[name][0] for a in alone], rel=1e-12)
