import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from moleval.operators import joins as J
from moleval.operators import ordered as O
from moleval.operators.common import exact_median, with_sequence_index


def edges_df(spark, cases):
    rows = [(mid, i, b, e, True) for mid, es in cases.items() for i, (b, e) in enumerate(es)]
    rows.append(("none", 0, 0, 1, False))
    return spark.createDataFrame(rows, "mol_id string, bond_idx int, begin int, end int, flag boolean")


def test_longest_connected_run(spark):
    cases = {"a": [(0, 1), (1, 2), (4, 5), (5, 6), (6, 7)], "b": [(0, 1), (2, 3), (1, 2)], "c": [(3, 4)]}
    res = {r["mol_id"]: r["longest_run"] for r in O.longest_connected_run(
        edges_df(spark, cases), "mol_id", ["bond_idx"], "begin", "end", "flag").collect()}
    assert res == {"a": 3, "b": 2, "c": 1, "none": 0}


def dedup(spark, values, errors=None, window=5):
    rows = [(1, i, float(v), float(errors[i]) if errors else 0.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, o long, v double, err double")
    out = O.recent_dedup(df, "k", ["o"], "v", error="err" if errors else None, window=window,
                         keep=["o"]).orderBy("o").collect()
    return [r["outcome"] for r in out]


def test_recent_dedup_micro(spark):
    got = dedup(spark, [1, 2, 1, 3, 4, 5, 6, 1])
    assert got == ["accepted", "accepted", "duplicate", "accepted", "accepted", "accepted", "accepted",
                   "accepted"]
    got = dedup(spark, [1, 2, 3], errors=[0, 20, 19.99])
    assert got == ["accepted", "rejected", "accepted"]


def test_recent_dedup_events_golden(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        "user_id", "event_id", "ts", F.bround("value", 1).alias("key"))
    out = O.recent_dedup(ev, "user_id", ["ts", "event_id"], "key", keep=["event_id"])
    assert out.count() == 1000
    assert out.where(F.col("outcome") == "accepted").count() == 992


def test_batch_ids(spark):
    df = spark.range(1, 24).withColumnRenamed("id", "cid")
    got = [r["id_list"] for r in O.batch_ids(df, "cid", ["cid"], k=10).orderBy("chunk").collect()]
    assert got == [",".join(map(str, range(1, 11))), ",".join(map(str, range(11, 21))), "21,22,23"]


def test_first_match_lookup(spark):
    rows = spark.createDataFrame([("A", 1.0, 0), ("B", 2.0, 1), ("A", 3.0, 2)], "k string, v double, o int")
    got = J.first_match_lookup(rows.select("k", "o"), rows, "k", "v", "o", name="first").orderBy("o").collect()
    assert [r["first"] for r in got] == [1.0, 2.0, 1.0]


def test_sequence_index_matches_sort(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 5, 3000)          # heavy ties: 5 hot keys
    vals = rng.normal(size=3000)
    df = spark.createDataFrame([(int(k), float(v), i) for i, (k, v) in enumerate(zip(keys, vals))],
                               "k int, v double, id int")
    s = with_sequence_index(df, ["k", "v", "id"], num_partitions=7).orderBy("seq").collect()
    assert [r["seq"] for r in s] == list(range(3000))
    order = sorted(range(3000), key=lambda i: (keys[i], vals[i], i))
    assert [r["id"] for r in s] == order


def test_exact_median_skewed(spark):
    rng = np.random.default_rng(2)
    g = np.where(rng.random(4001) < 0.7, 0, rng.integers(1, 4, 4001))
    v = rng.normal(size=4001).round(3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()}
    for k in set(g.tolist()):
        assert got[k] == pytest.approx(float(np.median(v[g == k])), abs=1e-12)
    glob = exact_median(df, [], "v").first()["median"]
    assert glob == pytest.approx(float(np.median(v)), abs=1e-12)


def test_positional_split(spark):
    df = spark.range(100).withColumnRenamed("id", "pos")
    s = O.positional_split(df, ["pos"], 29, gap=1)
    parts = {r["part"]: r["n"] for r in s.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"fit": 29, "val": 70}
    assert s.where("pos = 29").count() == 0


def test_sample_n(spark):
    df = spark.range(500)
    a = {r["id"] for r in O.sample_n(df, 40, "id", seed=7).collect()}
    b = {r["id"] for r in O.sample_n(df, 40, "id", seed=7).collect()}
    c = {r["id"] for r in O.sample_n(df, 40, "id", seed=8).collect()}
    assert len(a) == 40 and a == b and a != c
    with pytest.raises(ValueError):
        O.sample_n(df, 501, "id")


def test_longest_run_methods_agree(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for mid in range(60):
        n = 400 if mid == 0 else rnd.randint(0, 12)      # one hot id
        for i in range(n):
            rows.append((f"m{mid}", i, rnd.randint(0, 4), rnd.randint(0, 4), rnd.random() < 0.8))
    df = spark.createDataFrame(rows, "mol_id string, bond_idx int, begin int, end int, flag boolean")
    a = {r["mol_id"]: r["longest_run"] for r in O.longest_connected_run(
        df, "mol_id", ["bond_idx"], "begin", "end", "flag").collect()}
    b = {r["mol_id"]: r["longest_run"] for r in O.longest_connected_run(
        df, "mol_id", ["bond_idx"], "begin", "end", "flag", method="window").collect()}
    assert a == b and len(a) == len({r[0] for r in rows})


def test_sequence_index_after_a_shuffle(spark):
    """Input rows come out of a shuffle (no fixed order inside partitions);
    the materialised index must still be exactly 0..n-1 in key order."""
    base = spark.range(0, 20000).select((F.col("id") % 997).alias("k"), F.col("id"))
    shuffled = base.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("id").alias("m"))
    s = with_sequence_index(shuffled, ["c", "k"], num_partitions=6)
    rows = s.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(997))
    keys = [(r["c"], r["k"]) for r in rows]
    assert keys == sorted(keys)
