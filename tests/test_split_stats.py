import math

import pytest
from pyspark.sql import functions as F

from moleval.functions.tdist import t_two_sided_p
from moleval.operators import rank as RK
from moleval.operators import split as SP
from moleval.operators import stats as ST


@pytest.mark.parametrize("t,df,p", [
    (2.228138851986, 10.0, 0.05), (1.959963984540, 1e6, 0.05), (1.0, 1.0, 0.5),
    (0.0, 5.0, 1.0), (12.706204736175, 1.0, 0.05), (3.169272672617, 10.0, 0.01),
])
def test_t_pvalue_quantiles(spark, t, df, p):
    got = spark.createDataFrame([(t, df)], "t double, df double").select(
        t_two_sided_p("t", "df").alias("p")).first()["p"]
    assert got == pytest.approx(p, rel=1e-5, abs=1e-9)


def test_t_pvalue_invalid(spark):
    got = spark.createDataFrame([(1.0, None), (None, 3.0), (1.0, 0.5)], "t double, df double").select(
        t_two_sided_p("t", "df").alias("p")).collect()
    assert all(r["p"] is None for r in got)


def test_welch_matches_closed_form(spark):
    a = [1.0, 2.0, 3.0, 4.0]
    b = [2.0, 4.0, 6.0, 8.0, 10.0]
    rows = [("m", "good", x) for x in a] + [("m", "outlier", x) for x in b]
    df = spark.createDataFrame(rows, "model string, outcome string, f double")
    r = ST.welch_ttest(df, "model", "f").first()
    va, vb = (sum((x - 2.5) ** 2 for x in a) / 3), (sum((x - 6) ** 2 for x in b) / 4)
    t = (2.5 - 6) / math.sqrt(va / 4 + vb / 5)
    assert r["t"] == pytest.approx(t, rel=1e-12)


def greedy(sizes, frac):
    cap = math.floor(sum(sizes.values()) * frac + 1e-9)
    used, out = 0, {}
    for k, n in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        out[k] = "train" if used + n <= cap else "test"
        used += n if out[k] == "train" else 0
    return out


def test_group_split_greedy(spark):
    rows = [(f"k{k:03d}", i) for k in range(120) for i in range((k * 7) % 13 + 1)]
    df = spark.createDataFrame(rows, "key string, i int")
    s = SP.group_split(df, "key", 0.8)
    per_key = s.groupBy("key").agg(F.countDistinct("split").alias("n_sides"), F.first("split").alias("split"))
    assert per_key.where("n_sides > 1").count() == 0
    sizes = {}
    for k, _ in rows:
        sizes[k] = sizes.get(k, 0) + 1
    assert {r["key"]: r["split"] for r in per_key.collect()} == greedy(sizes, 0.8)
    train = s.where("split = 'train'").count()
    assert train <= math.floor(len(rows) * 0.8)


def test_group_split_hash(spark):
    df = spark.range(2000).select((F.col("id") % 97).alias("key"), "id")
    s = SP.group_split(df, "key", 0.8, method="hash")
    assert s.groupBy("key").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_leaderboard(spark):
    rows = [("c1", 10.0, 9.0), ("c1", 10.0, 10.0), ("c2", 10.0, 10.5), ("c3", 1.0, 1.5)]
    lb = {r["candidate"]: r for r in RK.leaderboard(
        spark.createDataFrame(rows, "cand string, a double, p double"), "cand", "a", "p").collect()}
    assert lb["c1"]["mean_score"] == -0.5 and lb["c1"]["rank"] == 1
    assert lb["c2"]["rank"] == 1 and lb["c3"]["rank"] == 1
    assert [k for k, v in lb.items() if v["is_best"]] == ["c1"]
