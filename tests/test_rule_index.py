"""The rule index: keys never exclude a match, any number of rules, NULL and repeated ids, linear fold."""
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moleval.operators import patterns as P
from moleval.operators import rules as R

RULE_SCHEMA = "rule_index int, original string, group string, new_1 string, new_2 string, new_3 string"


def keys_of(text):
    out = {P.ANY} | {text[i:i + q] for q in (1, 2, 3) for i in range(len(text) - q + 1)}
    return out | {P.HEAD + text[:q] for q in (1, 3) if len(text) >= q}


def holds(pattern, text):
    """Any single literal piece, or one of the others, must be a key of the text."""
    keys = P.pattern_keys(pattern)
    have = keys_of(text)
    return all(k in have for k in keys) if len(keys[0]) <= P.GRAM else any(k in have for k in keys)


atom = st.one_of(st.sampled_from(list("abcx1 -") + [r"\d", r"\w", r"\s", ".", "[ab]", "[^a]", "[a-c1]", r"\W", r"\.", "#", "(?:ab|c)", "(a|bc1)", "(?=a)", r"\b", "[]x]", "[a-]"]))
piece = st.builds(lambda a, q: a + q, atom, st.sampled_from(["", "", "", "*", "+", "?", "{2}", "{1,3}", "{0,2}", "{2,}", "+?", "*?"]))
sequence = st.builds(lambda x, a, z: a + "".join(x) + z, st.lists(piece, min_size=1, max_size=5), st.sampled_from(["", "^", "^"]), st.sampled_from(["", "$"]))
pattern = st.builds("|".join, st.lists(sequence, min_size=1, max_size=3))


@settings(max_examples=600, deadline=None)
@given(pattern, st.text(alphabet="abcx1 -#.]_", max_size=8))
def test_keys_never_exclude_a_match(p, text):
    try:
        found = re.search(p, text)
    except re.error:
        return
    if found:
        assert holds(p, text), (p, text, P.pattern_keys(p))


@pytest.mark.parametrize("p,keys", [
    (r"^\d{13}$", [P.HEAD + c for c in "0123456789"]), (r"^\S*#{3,}$", ["###"]), (r"foo|bar", [P.ANY]), (r"(abc)+x", ["abc"]), (r"(\w)\1", [P.ANY]),
    (r"(?i)abc", [P.ANY]), (r"\Qa.b\E", [P.ANY]), (r"^a?b", [P.HEAD + "a", P.HEAD + "b"]), (r"[unclosed", [P.ANY]), (r"x", ["x"]), (r"^$", [P.ANY]), (r"\x41bcd", [P.ANY]), (r"^ab+c", [P.HEAD + "a"]), (r"^abc|^abd", [P.HEAD + "a"]), (r"^(?:abc)+x?", [P.HEAD + "abc"])])
def test_keys_of_a_pattern(p, keys):
    assert P.pattern_keys(p) == keys


def many_rules(n, seed=1):
    rng = random.Random(seed)
    stem = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 5)))
    out = []
    for i in range(n):
        kind = i % 5
        p = stem()
        out.append((i, [f"^{p}$", p, f"{p}\\d+", f"^{p}.*z$", f"{p[:2]}x?{p[2:]}"][kind], f"g{i % (n // 2)}", f"^{stem()}\\W$" if i % 3 == 0 else None, None, None))
    return out + [(n, r"^\d{2,}$", "digits", None, None, None), (n + 1, r"q.q|w.w", "any", None, None, None)]


def brute(rows, long):
    """{(row number, pos, group_rank, pattern_rank)} of texts by plain tests."""
    compiled = [(r.group_rank, r.pattern_rank, re.compile(r.pattern)) for r in long if r.is_valid and r.group_rank is not None]
    return {(i, pos, g, k) for i, (_, t) in enumerate(rows) for pos, tok in enumerate(re.split(r"\s+", t) if t is not None else []) for g, k, c in compiled if c.search(tok)}


def texts(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) + rng.choice(["", "", "12", "!", "z"])
    rows = [(i, " ".join(rng.choice([word(), word(), str(rng.randint(0, 99)), "qaq", "é", ""]) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return rows + [(None, "abc 12 cab"), (None, "abc 12 cab"), (3, "other text 77"), (3, None), (n, "")]


@pytest.mark.parametrize("broadcast_up_to", [64 << 20, 0])
def test_5000_rules_against_brute_force(spark, monkeypatch, broadcast_up_to):
    monkeypatch.setattr(R, "INDEX_BYTES", broadcast_up_to)
    long = R.rules_to_long(spark.createDataFrame(many_rules(5_000), RULE_SCHEMA)).cache()
    rows = texts(60)
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k int, id int, text string")
    toks = R.tokenize(df, "k", "text")
    got = {(r.k, r.pos, r.group_rank, r.pattern_rank) for r in R.match_rules(toks, long, "k").collect()}
    want = brute(rows, long.collect())
    assert got == want and len(want) > 50
    # the row form keeps rows with NULL and repeated ids, each with its own groups
    per_row = R.tag_rows(df, "id", "text", long, target=r"\d", keep=["k", "id"]).collect()
    assert sorted(r.k for r in per_row) == list(range(len(rows)))
    plain = {r.k: r for r in R.assign_groups(R.match_rules(toks, long, "k"), "k", rows=df.select("k"), targets=toks.where(F.col("token").rlike(r"\d"))).collect()}
    for r in per_row:
        p = plain[r.k]
        assert (r.id, r.groups, r.n_assigned, r.n_targets, r.unassigned) == (rows[r.k][0], p.groups, p.n_assigned, p.n_targets, p.unassigned)


def test_50000_rules_equal_brute_force(spark):
    """Every rule is a literal word; a token meets those that share a rare piece with it."""
    words = ["".join("abcdefghijklmnopqrstuvwxyz"[(i // 26 ** k + 7 * k) % 26] for k in range(6)) for i in range(50_000)]
    rules = spark.createDataFrame([(i, f"^{w}$", f"g{i}") for i, w in enumerate(words)], "rule_index int, original string, group string")
    long = R.rules_to_long(rules, extra=()).cache()
    rows = [(k, " ".join(words[(k * 37 + j * 911) % 50_000] + ("" if j % 2 else "x") for j in range(20))) for k in range(200)]
    index = R.rule_index(long)
    assert index.rows.count() == 50_000 and index.rows.groupBy("_key").count().agg(F.max("count")).first()[0] < 2_000
    got = R.match_rules(R.tokenize(spark.createDataFrame(rows, "id int, text string"), "id", "text"), long, "id")
    assert {(r.id, r.pos, r.group) for r in got.collect()} == {(k, j, f"g{(k * 37 + j * 911) % 50_000}") for k in range(200) for j in range(20) if j % 2}


def test_no_usable_rule_keeps_all_columns(spark):
    long = R.rules_to_long(spark.createDataFrame([(1, "[broken", "g", None, None, None)], RULE_SCHEMA))
    df = spark.createDataFrame([(1, "a 1"), (None, None)], "id int, text string")
    got = R.tag_rows(df, "id", "text", long, target=r"\d").collect()
    assert sorted((r.id or 0, r.groups, r.n_assigned, r.n_targets, r.unassigned) for r in got) == [(0, [R.NO_GROUPS], 0, 0, 0), (1, [R.NO_GROUPS], 0, 1, 1)]
    assert R.match_rules(R.tokenize(df, "id", "text"), long, "id").count() == 0 and R.match_phrases(df, "id", "text", long).count() == 0


def test_phrases_against_brute_force(spark):
    rules = [(1, r"^[A-Z]\w+ [A-Z]\w+$", "names", None, None, None), (2, r"^\d+ \w+ \d+$", "between", r"^ \d+$", None, None), (3, r"of the", "of", None, None, None), (4, r"^\w+$", "word", None, None, None)]
    rng = random.Random(5)
    rows = [(i, rng.choice(["", " "]) + " ".join(rng.choice(["New", "York", "of", "the", "12", "x", "3", "off", "theme", "é"]) for _ in range(rng.randint(0, 15)))) for i in range(80)] + [(80, None), (81, "")]
    long = R.rules_to_long(spark.createDataFrame(rules, RULE_SCHEMA))
    got = {(r.id, r.group_rank, r.pattern_rank, tuple(r.positions)) for r in R.match_phrases(spark.createDataFrame(rows, "id int, text string"), "id", "text", long).collect()}
    want = set()
    for r in long.collect():
        n = r.pattern.count(" ") + 1
        for i, t in rows:
            toks = re.split(r"\s+", t) if t is not None else []
            want |= {(i, r.group_rank, r.pattern_rank, tuple(range(p, p + n))) for p in range(len(toks) - n + 1) if re.search(r.pattern, " ".join(toks[p:p + n]), re.A)}
    assert got == want and len(want) > 100


def plain_fold(matches):
    """W3 by rescanning all assigned matches."""
    assigned = []
    for rank, pattern_rank, _, name, pos in sorted(matches):
        over = [a for a in assigned if set(a[2]) & set(pos)]
        if over and any(a[0] == rank for a in over):
            continue
        if over and pattern_rank == 0:
            return None, sorted({p for a in assigned for p in a[2]})
        assigned.append((rank, name, pos))
    return [a[1] for a in assigned] or [R.NO_GROUPS], sorted({p for a in assigned for p in a[2]})


MATCH_SCHEMA = "id int, group_rank int, pattern_rank int, match_no bigint, group string, positions array<int>"


def test_fold_equals_rescanning(spark):
    rng = random.Random(9)
    rows = []
    for i in [None, *range(150)]:
        for n in range(rng.randint(1, 14)):
            rank = rng.randint(0, 4)
            start = rng.randint(0, 25)
            rows.append((i, rank, rng.choice([0, 1, 1, 2]), n, f"g{rank}", list(range(start, start + rng.randint(1, 3)))))
    got = {r.id: (r.groups, r.assigned_positions) for r in R.assign_groups_fold(spark.createDataFrame(rows, MATCH_SCHEMA), "id", rows=spark.createDataFrame([(None,), *((i,) for i in range(152))], "id int")).collect()}
    want = {i: plain_fold([r[1:] for r in rows if r[0] == i]) for i in [None, *range(152)]}
    assert got == want and any(g is None for g, _ in want.values())


def test_fold_of_a_row_with_100000_matches(spark):
    m = spark.range(100_000).select(F.lit(1).alias("id"), (F.col("id") % 50).cast("int").alias("group_rank"), F.lit(1).alias("pattern_rank"), F.col("id").alias("match_no"),
                                    F.concat(F.lit("g"), F.col("id") % 50).alias("group"), F.array((F.col("id") * 2).cast("int"), (F.col("id") * 2 + 1).cast("int")).alias("positions"))
    start = time.time()
    got = R.assign_groups_fold(m, "id").select(F.size("groups").alias("g"), F.size("assigned_positions").alias("p")).first()
    assert (got.g, got.p) == (100_000, 200_000) and time.time() - start < 60
