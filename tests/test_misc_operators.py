import numpy as np
import pytest
from pyspark.sql import functions as F

from moleval.functions import scalars as S
from moleval.operators import filters as FL
from moleval.operators import joins as J
from moleval.operators import common as CM
from moleval.operators import metrics as M
from moleval.operators import ordered as O
from moleval.operators import rules as R


def test_log_texts(spark):
    df = spark.createDataFrame([(85.4, 80.0)], "a double, p double")
    q, a = S.log_texts("a", "p")
    r = df.select(q.alias("q"), a.alias("a")).first()
    assert (r["q"], r["a"]) == ("True TPSA: 85.4", "Predicted TPSA: 80.0")


def test_random_keys_seeded(spark):
    a = [r["key"] for r in S.random_keys(spark, 200, 1000, seed=1).orderBy("draw").collect()]
    b = [r["key"] for r in S.random_keys(spark, 200, 1000, seed=1).orderBy("draw").collect()]
    c = [r["key"] for r in S.random_keys(spark, 200, 1000, seed=2).orderBy("draw").collect()]
    assert a == b and a != c and all(1 <= k <= 1000 for k in a)


def test_semi_filter_and_exclude(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("c",), ("c",)], "k string")
    assert sorted(r["k"] for r in J.semi_filter(df, keys, "k").collect()) == ["a", "c"]
    assert sorted(r["k"] for r in FL.exclude_values(df, "k", ["b"]).collect()) == ["a", "c"]


def test_remap_codes(spark):
    dim = spark.createDataFrame([("[OH]", "Alcohol"), ("[O]=", "Carbonyl")], "code string, name string")
    df = spark.createDataFrame([("[OH]", 9.23), ("[O]=", 17.07)], "code string, v double")
    got = {r["code"]: r["name"] for r in J.remap_codes(df, dim, "code", "name").collect()}
    assert got == {"[OH]": "Alcohol", "[O]=": "Carbonyl"}
    bad = spark.createDataFrame([("[N]", 3.0)], "code string, v double")
    with pytest.raises(Exception):
        J.remap_codes(bad, dim, "code", "name").collect()


def test_feature_summaries_match_numpy(spark):
    rng = np.random.default_rng(4)
    models = rng.choice(["m1", "m2"], 500)
    feat = rng.integers(0, 6, 500).astype(float)
    cls = rng.choice(["good", "outlier"], 500)
    df = spark.createDataFrame([(m, float(f), c) for m, f, c in zip(models, feat, cls)],
                               "model string, f double, outcome string")
    pop = {r["model"]: r for r in M.feature_summary(df, "model", "f", ddof=0).collect()}
    samp = {r["model"]: r for r in M.feature_summary(df, "model", "f", ddof=1).collect()}
    for m in ("m1", "m2"):
        x = feat[models == m]
        assert pop[m]["std"] == pytest.approx(np.std(x), rel=1e-12)
        assert samp[m]["std"] == pytest.approx(np.std(x, ddof=1), rel=1e-12)
    allx = {r["label"]: r for r in M.feature_summary_with_all(df, "model", "f", all_models=["m1"]).collect()}
    assert set(allx) == {"m1 (outlier)", "m2 (outlier)", "m1 (All)"}
    assert allx["m1 (All)"]["n"] == int((models == "m1").sum())
    x = feat[(models == "m2") & (cls == "outlier")]
    assert allx["m2 (outlier)"]["mean"] == pytest.approx(x.mean(), rel=1e-12)


def test_error_class_null_is_neither(spark):
    df = spark.createDataFrame([(1.0,), (1.0001,), (None,)], "e double")
    got = [r["c"] for r in df.select(FL.error_class("e", 1.0).alias("c")).collect()]
    assert got == ["good", "outlier", None]


def test_with_model_predictions_dispatch(spark):
    from moleval.operators import predict as P
    df = spark.createDataFrame([(1, "CCO", "long prompt CCO"), (2, "CN", "long prompt CN")],
                               "id int, smiles string, prompt string")
    long = P.with_model_predictions(
        df, {"direct_model": lambda s: s.str.len(), "tpsa_model_acf": lambda s: s.str.len() * 10},
        {"direct_model": "smiles", "tpsa_model_acf": "prompt"}, keep=["id"])
    got = sorted((r["model"], r["id"], r["pred"]) for r in long.collect())
    assert got == [("direct_model", 1, 3.0), ("direct_model", 2, 2.0),
                   ("tpsa_model_acf", 1, 150.0), ("tpsa_model_acf", 2, 140.0)]


def test_values_of_repeated_names_add_up(spark):
    rows = spark.createDataFrame([(1, ["a", "a", "b"]), (2, None), (3, ["zz"]), (4, [])], "id int, groups array<string>")
    values = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("b", 5.0, 2)], "group string, tpsa_contribution double, rank int")
    got = {x["id"]: x["additive_score"] for x in R.additive_score(rows, values).collect()}
    assert got == {1: 11.0, 2: None, 3: 0.0, 4: 0.0}
    table = {x["id"]: len(x["data_table"]) for x in J.attach_value_table(rows, "groups", values).collect()}
    assert table == {1: 3, 2: 1, 3: 0, 4: 0}         # every value row of a name once


@pytest.mark.parametrize("broadcast_up_to", [64 << 20, 0])
def test_rules_with_and_without_broadcast(spark, monkeypatch, broadcast_up_to):
    monkeypatch.setattr(R, "INDEX_BYTES", broadcast_up_to)
    rules = R.rules_to_long(spark.createDataFrame([(i, f"^w{i}$", f"g{i}", None, None, None) for i in range(10)],
                                                  "rule_index int, original string, group string, new_1 string, new_2 string, new_3 string"))
    tokens = R.tokenize(spark.createDataFrame([(1, "w0 w7 x w9 w7")], "id int, text string"), "id", "text")
    assert sorted((x["group"], x["pos"]) for x in R.match_rules(tokens, rules, "id").collect()) == [("g0", 0), ("g7", 1), ("g7", 4), ("g9", 3)]
    flagged = R.match_rules(tokens, rules, "id", flag=F.col("token") == "x").collect()
    assert sorted((x["group"] or "", x["pos"], x["is_target"]) for x in flagged) == [("", 2, True), ("g0", 0, False), ("g7", 1, False), ("g7", 4, False), ("g9", 3, False)]


def test_back_references_and_named_groups(spark):
    rules = R.rules_to_long(spark.createDataFrame([(1, r"^(x)y$", "a", None, None, None), (2, r"^(\d)\1$", "b", None, None, None),
                                                   (3, r"^(?<n>p)q$", "c", None, None, None), (4, r"^(?<n>r)s$", "d", None, None, None)],
                                                  "rule_index int, original string, group string, new_1 string, new_2 string, new_3 string"))
    tokens = R.tokenize(spark.createDataFrame([(1, "77 xy 12 pq rs")], "id int, text string"), "id", "text")
    assert sorted((x["group"], x["pos"]) for x in R.match_rules(tokens, rules, "id").collect()) == [("a", 1), ("b", 0), ("c", 3), ("d", 4)]


def test_recent_values_keep_all_digits_and_nulls(spark):
    rows = [(1, 0, 2**53), (1, 1, 2**53 + 1), (None, 2, None), (None, 3, None), (None, 4, 5)]
    got = O.recent_dedup(spark.createDataFrame(rows, "k bigint, i int, v bigint"), "k", ["i"], "v", keep=["i"]).collect()
    assert {x["i"]: x["outcome"] for x in got} == {0: "accepted", 1: "accepted", 2: "accepted", 3: "duplicate", 4: "accepted"}


def test_median_of_mostly_equal_values(spark):
    rows = [("a", 0.0)] * 500 + [("a", float(i)) for i in range(-200, 200)] + [(None, -1.5), (None, 4.0), ("n", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x["g"]: (x["m"], x["_n"]) for x in CM.exact_median(df, ["g"], "v", "m").collect()}
    assert got == {"a": (0.0, 900), None: (1.25, 2)}
    plan = CM.exact_median(df, ["g"], "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "CheckpointRDD" not in plan
