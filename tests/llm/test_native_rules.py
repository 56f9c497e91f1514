"""URL rules, adaptive quality rules and systematic mixing against plain Python."""
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from moleval.llm import adaptive_rules, mix_systematic, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def repeats(words, n=5):
    at = {}
    for i in range(len(words) - n + 1):
        at.setdefault(tuple(words[i:i + n]), []).append(i)
    return len({p + k for v in at.values() if len(v) > 1 for p in v for k in range(n)})


def long_text(n=30_000):
    return " ".join(f"w{i % 977}x{i % 31}" for i in range(n))


ODD = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n", "en", "a", 3), (4, "one\n\none\ntwo \none", "en", None, 1),
       (5, "a b c d e f a b c d e x", "de", "b", 2), (5, "a b c d e f a b c d e x", "de", "b", 2), (6, "é# ü* $%&|<> z", "de", "b", 2),
       (7, "x " * 40, "fr", "c", 9), (None, "no id here at all " * 4, "fr", "c", 9), (8, long_text(), "en", "a", 7)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"row": F.lit("r"), "size": F.lit(1), "n_words": F.lit(2), "_k": F.lit(3)})


def test_base_counts_of_odd_texts(odd):
    got = {(r.i, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in adaptive_rules.judge(odd, keep=["doc_id"]).withColumn("i", F.col("row.doc_id")).collect()}
    want = set()
    for i, t, *_ in ODD:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        rep = repeats(w)
        want.add((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep,
                  len(w) < 10 or 100 * rep > 20 * len(w)))
    assert got == want


def test_limits_follow_the_group_not_a_constant(spark):
    """A source where every text has symbols keeps them; an odd one out elsewhere goes."""
    plain = " ".join(f"word{i}" for i in range(30))
    noisy = " ".join(f"word{i}$$" for i in range(30))
    rows = [(i, plain, "en", "clean", 0) for i in range(50)] + [(100 + i, noisy, "en", "code", 0) for i in range(50)] + [(999, noisy, "en", "clean", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in adaptive_rules.filter_documents(docs, min_docs=20).collect()}
    assert 999 not in kept and set(range(50)) <= kept and set(range(100, 150)) <= kept


def test_small_groups_use_merged_sketches(spark):
    plain = " ".join(f"word{i}" for i in range(30))
    noisy = " ".join(f"word{i}$$" for i in range(30))
    rows = [(i, plain, "en", f"s{i}", 0) for i in range(60)] + [(999, noisy, "en", "own", 0)]
    kept = {r.doc_id for r in adaptive_rules.filter_documents(spark.createDataFrame(rows, SCHEMA), min_docs=20).collect()}
    assert kept == set(range(60))


def test_filter_keeps_columns_and_empty_table(odd, spark):
    assert adaptive_rules.filter_documents(odd).columns == odd.columns
    assert adaptive_rules.filter_documents(odd.limit(0)).count() == 0


def targets_by_loop(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    """Sources in code point order (null last); hand out by weight until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return share | {s: float(cap * sizes[s]) for s in full}
        full |= over


def test_mix_targets_and_copies(spark):
    rows = [(i, "w " * (i % 50 + 1), "en", s, 0) for i, s in enumerate((["a"] * 40 + ["b"] * 300 + ["c"] * 5 + [None] * 30 + ["é"] * 7))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_systematic.systematic_copies(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = targets_by_loop(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2 * 50
    again = mix_systematic.systematic_copies(docs.repartition(7)).select("row.doc_id", "copies").collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in got}


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    names = [chr(97 + i) for i in range(rng.randrange(1, 24))] + [None]
    sizes = {n: rng.choice((0, 1, 40, 1000, 10 ** rng.randrange(1, 7))) for n in names}
    table = spark.createDataFrame([("b" if n is None else "a" + n, v) for n, v in sizes.items()], "_k string, _words bigint")
    got = {r._k: r._target for r in mix_systematic.source_targets(table).collect()}
    want = targets_by_loop(sizes) if sum(sizes.values()) else dict.fromkeys(names, 0.0)
    assert got == {("b" if n is None else "a" + n): pytest.approx(v) for n, v in want.items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_emits_copies_and_handles_odd_rows(odd):
    plan = mix_systematic.systematic_copies(odd).collect()
    assert len(plan) == len(ODD)
    out = mix_systematic.mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in plan)
    assert all(r.copies == 0 for r in plan if r.source_size == 0)
    assert mix_systematic.mix(odd.limit(0)).count() == 0


URLS = [(1, "https://A.Example.NET/en/1?x=/y"), (2, "http://example.net/EN/1"), (3, "ftp://b.example.com/de/q#f"), (4, "http://org/fr/"),
        (5, "http://notorg/fr/"), (6, None), (7, "no scheme"), (8, "http://x.net"), (9, "http://spam-farm.example.com/en/1"),
        (10, "a://b://c.org/fr/"), (11, "http://host?x=://y.net/"), (12, "http://quiet.example.com/en/1")]


def rule_by_loop(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def test_url_parts_rules_and_learned_verdict(spark):
    more = [(100 + i, f"http://quiet{i % 7}.example.com/en/{i}") for i in range(60)] + [(200 + i, f"http://www.spam-farm.example.com/en/{i}") for i in range(9)]
    pages = spark.createDataFrame(URLS + more, "page_id bigint, url string").withColumns({"row": F.lit(1), "host": F.lit("x"), "words": F.lit(2)})
    got = {r.i: r for r in url_filter.judge(pages, keep=["page_id"]).withColumn("i", F.col("row.page_id")).collect()}
    for i, url in URLS:
        rest = url.split("://", 1)[1] if url and "://" in url else None
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest) if rest is not None else None
        host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
        path = m[2] if m else ""
        assert (got[i].host, got[i].path) == (host, path)
        best = rule_by_loop(host, path)
        assert got[i].rule == (best[0] if best else None)
        if best:
            assert got[i].verdict == best[1]
    assert got[9].verdict == "block" and got[12].verdict == "allow" and got[6].verdict == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_viterbi_splits_concatenated_names():
    words = {w: n for w, n in (("cheap", -3.0), ("pills", -3.2), ("che", -5.0), ("online", -3.5), ("", 6.0))}
    assert url_filter.Segmenter(words).words_of("CheapPillsOnline.7") == ["cheap", "pills", "online"]


def test_words_of_any_rank_and_length_split_names(spark):
    common = " ".join("".join(p) for p in itertools.product("qjvkwzx", repeat=6)) + " " + "qj" * 14
    docs = spark.createDataFrame([(common + " " + common,), ("free best gambling",), (None,)], "text string")
    names = ["freepoker", "bestviagra", "gambling", "qj" * 14 + "best", "nosuchword"]
    pages = spark.createDataFrame([(i, f"http://{n}.example.com/en/free{n}") for i, n in enumerate(names)] + [(9, None)], "page_id bigint, url string")
    got = {r.i: r.words for r in url_filter.judge(pages, docs, keep=["page_id"]).select("words", F.col("row.page_id").alias("i")).collect()}
    assert [got[i].host[:-2] for i in range(3)] == [["free", "poker"], ["best", "viagra"], ["gambling"]]
    assert got[3].host[:2] == ["qj" * 14, "best"] and got[4].host[-1] == "com"
    assert got[0].path == ["en", "free", "free", "poker"] and got[9].host == got[9].path == []
