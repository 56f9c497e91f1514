"""End-to-end evaluation jobs over a long predictions table
``(model, smiles, calculated, pred, group_descriptions, num_n, num_o)``.

One table holds every model; each report is one grouped plan over it (no
loop over models on the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moleval.functions.scalars import first_number, nan_to_null
from moleval.operators import filters as FL
from moleval.operators import joins as J
from moleval.operators import metrics as M
from moleval.operators import stats as ST
from moleval.sources.tables import require_columns


def comparison_metrics(df: DataFrame, known: str = "Known_TPSA", predicted: str = "Predicted_TPSA",
                       limit: float = 1000.0, median: str = "exact") -> DataFrame:
    """Free-text predictions vs known values: column guard (S11) -> first
    number of each text column (P2; numeric columns pass through) -> drop
    missing (F1) -> keep predictions below ``limit`` (F2) -> RMSE, MAE and
    median error (A1), with the report's column names."""
    require_columns(df, [known, predicted])

    def num(c):
        return first_number(c) if dict(df.dtypes)[c] == "string" else nan_to_null(F.col(c).cast("double"))
    d = df.select(num(known).alias("Calculated_TPSA"), num(predicted).alias("Predicted_TPSA"))
    d = FL.drop_extreme(FL.drop_missing(d, ["Calculated_TPSA", "Predicted_TPSA"]), "Predicted_TPSA", limit)
    m = M.error_metrics(d, [], "Calculated_TPSA", "Predicted_TPSA", median=median)
    return m.select(F.col("rmse").alias("RMSE"), F.col("mae").alias("MAE"),
                    F.col("median_error").alias("Median Error"), "n")


def model_metrics(long: DataFrame, median: str = "exact") -> DataFrame:
    """A1 per model."""
    return M.error_metrics(long, "model", "calculated", "pred", median=median)


def significance_vs_base(long: DataFrame, base_model: str = "direct_model", key: str = "smiles") -> DataFrame:
    """J1 + A6: paired t-test of base minus each other model on shared keys."""
    pairs = J.pair_with_base(long, base_model, key)
    return ST.paired_ttest(pairs, "model", "base_pred", "pred")


def outlier_reports(long: DataFrame, threshold: float = 1.0, features=("num_n", "num_o"),
                    exclude=("direct_model",)) -> dict[str, DataFrame]:
    """F3 -> A2 counts, A9 property report (Welch tests), A3/A4 summaries
    of every feature (``summary_<feature>``)."""
    cls = FL.partition_by_error(long, "calculated", "pred", threshold)
    return {
        "counts": M.outcome_counts(cls, "model"),
        "report": ST.report_table(cls, "model", list(features), exclude=exclude),
    } | {f"summary_{f}": M.feature_summary(cls.where(F.col("outcome") == FL.OUTLIER), "model", f, ddof=1) for f in features}
