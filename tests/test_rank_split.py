"""A15 by ranges of means and W4 by boundary size, against plain rules."""
import random

import pytest
from pyspark.sql import functions as F

from moleval.operators import rank as RK
from moleval.operators import split as SP


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_with_ties_nulls_and_hot_values(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, float("nan"), 0.0, -0.0, 1.5, 1.5, -2.0, rng.random() * 1e-9 + 1, rng.gauss(0, 1e6)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, x double").repartition(7)
    got = {repr(r["x"] + 0.0) if r["x"] is not None else None: r["rank"] for r in RK.value_ranks(df, "x").collect()}
    key = lambda x: (x is not None, float("inf") if x != x else x) if x is not None else (False, 0)  # noqa: E731   NaN is the largest
    order = sorted((key(x) for _, x in rows), reverse=True)
    for _, x in rows:
        assert got[repr(x + 0.0) if x is not None else None] == 1 + order.index(key(x))


def test_leaderboard_of_a_million_candidates(spark):
    trials = spark.range(1_000_000).select("id", (F.col("id") * 7919 % 100_003).cast("double").alias("a"), F.lit(0.0).alias("p"))
    lb = RK.leaderboard(trials, "id", "a", "p")
    windows = [line for line in plan_of(lb).split("\n") if line.strip(" +-:").startswith("Window ")]
    assert windows and all("_pid" in w for w in windows)
    s = lb.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_if("is_best").alias("best"), F.countDistinct("rank").alias("n")).first()
    assert (s.lo, s.best, s.n) == (1, 1, 100_003)
    assert s.hi == 1_000_001 - trials.where("a = 100002").count()
    assert lb.where("is_best").first()["candidate"] == 0


def test_best_candidate_ties(spark):
    rows = [(None, 1.0, 1.0), (3, 1.0, 1.0), (2, 5.0, 1.0), (4, None, 1.0)]
    got = {r["candidate"]: (r["rank"], r["is_best"]) for r in RK.leaderboard(spark.createDataFrame(rows, "c int, a double, p double"), "c", "a", "p").collect()}
    assert got == {None: (1, True), 3: (1, False), 2: (3, False), 4: (4, False)}
    assert RK.leaderboard(spark.createDataFrame([], "c int, a double, p double"), "c", "a", "p").count() == 0


def plain_split(groups, frac):
    """{key: split}: groups by size, largest first, then by key, each if it still fits."""
    room, out = int(sum(groups.values()) * frac + 1e-9), {}
    for k, n in sorted(groups.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or 0)):
        out[k] = SP.TRAIN if n <= room else SP.TEST
        room -= n if n <= room else 0
    return out


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("frac", [0.8, 0.33, 0.0, 1.0])
def test_split_equals_the_plain_rule(spark, seed, frac):
    rng = random.Random(seed)
    groups = {k: rng.choice([1, 1, 1, 2, 2, 3, 5, 8, 40, 90][: 4 + 2 * seed]) for k in [None, *range(1, 60)]}
    df = spark.createDataFrame([(k,) for k, n in groups.items() for _ in range(n)], "k int").repartition(3)
    got = SP.group_split(df, "k", frac)
    assert {r["k"]: r["split"] for r in got.distinct().collect()} == plain_split(groups, frac)
    assert got.count() == sum(groups.values())


def test_runs_of_sizes():
    assert SP.walk_sizes([(10, 2), (4, 5), (1, 9)], 20) == SP.Runs(4, [], [])
    assert SP.walk_sizes([(10, 5), (4, 5), (1, 9)], 35) == SP.Runs(10, [(10, 3), (4, 1), (1, 1)], [10, 4, 1])
    assert SP.walk_sizes([(10, 1), (4, 1)], 14) == SP.Runs(0, [], [])


def test_split_ranks_only_groups_of_the_sizes_taken_in_part(spark, monkeypatch):
    seen = []
    inner = SP.with_sequence_index
    monkeypatch.setattr(SP, "with_sequence_index", lambda d, *a, **k: seen.append(d.count()) or inner(d, *a, **k))
    df = spark.range(1000).select(F.when(F.col("id") < 900, F.col("id") % 9).otherwise(F.col("id")).alias("k"))
    SP.group_split(df, "k", 0.2).count()
    assert seen == [9]


def test_empty_table(spark):
    assert SP.group_split(spark.createDataFrame([], "k int"), "k").count() == 0
