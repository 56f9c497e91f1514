"""Goldens computed from the saved study data (FIXTURES.md section 2)."""
import pytest
from pyspark.sql import functions as F

from conftest import fixture_path
from moleval.operators import filters as FL
from moleval.operators import metrics as M
from moleval.operators import rules as R
from moleval.plans import evaluation as EV
from moleval.sources import tables as SRC


@pytest.fixture(scope="module")
def long(spark):
    import os
    return SRC.read_prediction_set(
        spark, os.path.dirname(fixture_path("x")),
        ["tpsa_model_abcdef", "tpsa_model_abcdef_no_demos", "direct_model", "tpsa_model_missing"]).cache()


def test_published_comparison_metrics(spark):
    df = SRC.read_csv(spark, fixture_path("tpsa_comparison_results.csv"),
                      "SMILES string, Known_TPSA string, Predicted_TPSA string")
    for median in ("exact", "inline"):
        r = EV.comparison_metrics(df, median=median).first()
        assert r["n"] == 130
        assert r["RMSE"] == pytest.approx(177.59186587920925, abs=1e-9)
        assert r["MAE"] == pytest.approx(91.85348195133754, abs=1e-9)
        assert r["Median Error"] == pytest.approx(-29.3, abs=1e-9)


def test_model_metrics_and_counts(long):
    m = {r["model"]: r for r in EV.model_metrics(long).collect()}
    assert m["tpsa_model_abcdef"]["n"] == 140
    assert m["tpsa_model_abcdef"]["rmse"] == pytest.approx(11.7616, abs=1e-4)
    assert m["tpsa_model_abcdef"]["mae"] == pytest.approx(6.3944, abs=1e-4)
    assert m["tpsa_model_abcdef"]["median_error"] == pytest.approx(0.02, abs=1e-9)
    assert m["direct_model"]["rmse"] == pytest.approx(62.3383, abs=1e-4)
    assert m["direct_model"]["median_error"] == pytest.approx(49.43, abs=1e-9)
    assert m["tpsa_model_abcdef_no_demos"]["median_error"] == pytest.approx(35.3, abs=1e-9)
    c = {r["model"]: r for r in EV.outlier_reports(long)["counts"].collect()}
    assert (c["tpsa_model_abcdef"]["n_good"], c["tpsa_model_abcdef"]["n_outlier"]) == (60, 80)
    assert (c["direct_model"]["n_good"], c["direct_model"]["n_outlier"]) == (1, 139)
    c5 = FL.partition_by_error(long, "calculated", "pred", 5.0)
    c5 = {r["model"]: r["n_outlier"] for r in M.outcome_counts(c5, "model").collect()}
    assert c5["tpsa_model_abcdef"] == 45


def test_missing_model_report(long):
    miss = [r["model"] for r in SRC.missing_models(
        long, ["tpsa_model_abcdef", "tpsa_model_missing"]).collect()]
    assert miss == ["tpsa_model_missing"]


def test_group_lists(long):
    g = long.where(F.col("model") == "tpsa_model_abcdef")
    assert g.where(F.col("group_descriptions").isNull()).count() == 57
    sent = F.array_contains("group_descriptions", "No functional groups assigned.")
    assert g.where(sent).count() == 2


def test_paired_ttest(long):
    t = {r["model"]: r for r in EV.significance_vs_base(long).collect()}
    a = t["tpsa_model_abcdef"]
    assert a["n_pairs"] == 45
    assert a["t"] == pytest.approx(8.723361, abs=1e-5)
    assert a["p_value"] == pytest.approx(3.78246e-11, rel=1e-5)
    b = t["tpsa_model_abcdef_no_demos"]
    assert b["n_pairs"] == 58
    assert b["t"] == pytest.approx(3.993477, abs=1e-5)
    assert b["p_value"] == pytest.approx(0.000188611, rel=1e-5)


def test_welch_report(long):
    rep = {(r["model"], r["property"]): r for r in EV.outlier_reports(long)["report"].collect()}
    n = rep[("tpsa_model_abcdef", "num_n")]
    assert n["mean_good"] == pytest.approx(0.8833, abs=1e-4)
    assert n["mean_outlier"] == pytest.approx(2.05, abs=1e-4)
    assert n["t"] == pytest.approx(-5.182834, abs=1e-5)
    assert n["df"] == pytest.approx(137.8900, abs=1e-4)
    assert n["p_value"] == pytest.approx(7.60793e-07, rel=1e-5)
    assert n["significant"] is True
    o = rep[("tpsa_model_abcdef", "num_o")]
    assert o["p_value"] == pytest.approx(0.868159, rel=1e-5)
    assert o["significant"] is False
    nd = rep[("tpsa_model_abcdef_no_demos", "num_n")]      # one good row -> no test
    assert nd["n_good"] == 1 and nd["p_value"] is None and nd["significant"] is False
    assert nd["mean_good"] == pytest.approx(3.0)
    assert ("direct_model", "num_n") not in rep


def test_histogram_golden(spark):
    df = SRC.read_molecules(spark, fixture_path("tpsa_train_df.csv"))
    h = [r["count"] for r in M.histogram(df, "TPSA", 20).orderBy("bin").collect()]
    assert h == [2, 2, 8, 14, 9, 11, 12, 15, 10, 8, 5, 9, 9, 9, 5, 2, 4, 1, 1, 4]


def test_histogram_edge_cases(spark):
    same = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    h = M.histogram(same, "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [0, 0, 2, 0] and h[0]["bin_lo"] == 2.5 and h[-1]["bin_hi"] == 3.5
    empty = spark.createDataFrame([(None,)], "x double")
    assert M.histogram(empty, "x", 4).count() == 0


def test_additive_score_golden(spark, long):
    vals = SRC.read_csv(spark, fixture_path("tpsa_values.csv"), "group string, tpsa_contribution double")
    g = long.where((F.col("model") == "tpsa_model_abcdef") & F.col("group_descriptions").isNotNull())
    s = R.additive_score(g, vals, groups="group_descriptions")
    m = M.error_metrics(s, [], "calculated", "additive_score").first()
    assert m["n"] == 83
    assert m["rmse"] == pytest.approx(4.625502773063103, abs=1e-9)
    assert m["mae"] == pytest.approx(1.974096385542169, abs=1e-9)
    assert m["median_error"] == pytest.approx(0.0, abs=1e-12)


def test_unmatched_names_golden(spark):
    rules = SRC.read_rules(spark, fixture_path("tpsa_smarts.csv"))
    lr = R.rules_to_long(rules, validate=False)
    vals = SRC.read_csv(spark, fixture_path("tpsa_values.csv"), "group string, tpsa_contribution double")
    u = {(r["name"], r["side"]) for r in R.unmatched_names(lr, vals, "group", "group").collect()}
    assert u == {("Charged Imine", "left_only"), ("Aromatic Pyridine-like nitrogen", "left_only"),
                 ("Charged imine", "right_only"), ("Aromatic pyridine-like nitrogen", "right_only")}


def test_median_modes_agree(long):
    exact = {r["model"]: r["median_error"] for r in EV.model_metrics(long, median="exact").collect()}
    inline = {r["model"]: r["median_error"] for r in EV.model_metrics(long, median="inline").collect()}
    approx = {r["model"]: r["median_error"] for r in EV.model_metrics(long, median="approx").collect()}
    assert exact == pytest.approx(inline, abs=1e-12)
    for m, v in exact.items():        # percentile_approx returns a member value next to the midpoint
        assert abs(approx[m] - v) <= 5.0
