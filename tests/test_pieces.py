"""W1 and W2 over pieces of hot keys: equal to plain walks, many tasks, exact where windows never meet."""
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from moleval.operators import ordered as O


def plain_dedup(rows, window=5, max_err=20.0):
    """{order: outcome} of (key, order, value, error) rows."""
    out, state = {}, {}
    for k, o, v, e in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        recent = state.setdefault(k, deque(maxlen=window))
        out[o] = O.recency_walk(recent, [v], [e is None or abs(e) >= max_err])[0]
    return out


def dedup(spark, rows, parts, **kw):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k long, o long, v long, err double").repartition(3)
        return {r["o"]: r["outcome"] for r in O.recent_dedup(df, kw.pop("key", "k"), ["o"], "v", error="err", keep=["o"], **kw).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows_of(seed, n, values, hot=0.5):
    rng = random.Random(seed)
    return [(1 if rng.random() < hot else rng.choice([None, *range(2, 30)]), i, rng.choice([None, *range(values)]), rng.choice([0.0, 0.0, 5.0, 25.0, None])) for i in range(n)]


@pytest.mark.parametrize("values", [3, 6, 7, 40, 100_000])
def test_dedup_of_a_hot_key_equals_the_plain_walk(spark, values):
    rows = rows_of(values, 3000, values)
    assert dedup(spark, rows, 12) == plain_dedup(rows)


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_windows_that_never_meet(spark, monkeypatch, rounds):
    """Values in a cycle a little longer than the window: what a piece keeps depends on all pieces before."""
    monkeypatch.setattr(O, "ROUNDS", rounds)
    for cycle in (5, 6, 7, 8, 11):
        rows = [(1, i, (i * i // 3 + i) % cycle, 0.0) for i in range(1200)] + [(2, 5000 + i, i % cycle, 0.0) for i in range(300)]
        assert dedup(spark, rows, 16) == plain_dedup(rows)


def test_whole_table_as_one_key(spark):
    rows = [(1, o, v, e) for _, o, v, e in rows_of(3, 1500, 9)]
    assert dedup(spark, rows, 9, key=[]) == plain_dedup(rows)


def test_a_hot_key_has_many_tasks_and_few_jobs(spark, monkeypatch):
    """One key with all rows: its pieces are about as many as the partitions, and two rounds settle them."""
    monkeypatch.setattr(O, "ROUNDS", 1)
    rng = random.Random(4)
    rows = [(1, i, rng.randint(0, 30), 0.0) for i in range(8000)]
    seen = []
    inner = O._entries
    monkeypatch.setattr(O, "_entries", lambda pieces, order, window: seen.append(pieces.select("_pid").distinct().count()) or inner(pieces, order, window))
    assert dedup(spark, rows, 16) == plain_dedup(rows) and seen[0] >= 12


def test_rejected_rows_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, i, i % 4, 0.0 if i % 2 else 50.0) for i in range(100)], "k long, o long, v long, err double")
    plan = O.recent_dedup(df, "k", ["o"], "v", error="err", keep=["o"])._jdf.queryExecution().optimizedPlan().toString()
    rejected = [part for part in plan.split("\n") if "rejected" in part]
    assert rejected and "Union" in plan


def test_empty_table(spark):
    assert dedup(spark, [], 4) == {}


def plain_runs(rows):
    """{id: longest run} of (id, order, begin, end, flag) rows."""
    out, last, length = {}, {}, {}
    for i, _, b, e, f in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(i, 0)
        if not f:
            continue
        p = last.get(i)
        joined = p is not None and p[0] is not None and any(x is not None and x in p for x in (b, e))
        length[i] = length[i] + 1 if joined else 1
        last[i] = (b, e)
        out[i] = max(out[i], length[i])
    return out


@pytest.mark.parametrize("parts,batch", [(1, 10_000), (13, 10_000), (13, 7), (40, 3)])
def test_runs_of_hot_ids_equal_the_plain_walk(spark, parts, batch):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", None, "a", "b", f"x{i % 50}"]), i, rng.choice([None, *range(4)]), rng.choice([None, 0, 1, 2]), rng.choice([True, True, True, False, None])) for i in range(900)]
    rows += [("long", 1000 + i, 1, 1, True) for i in range(400)]
    keys = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(rows, "id string, o int, b int, e int, f boolean").repartition(4)
        got = {r["id"]: r["longest_run"] for r in O.longest_connected_run(df, "id", ["o"], "b", "e", "f").collect()}
        assert got == plain_runs(rows) and got["long"] == 400
        assert got == {r["id"]: r["longest_run"] for r in O.longest_connected_run(df, "id", ["o"], "b", "e", "f", method="window").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_runs_of_an_empty_table(spark):
    assert O.longest_connected_run(spark.createDataFrame([], "id string, o int, b int, e int, f boolean"), "id", ["o"], "b", "e", "f").count() == 0
