"""Significance tests and the property comparison report.

Each test is one grouped aggregate of algebraic moments (count, mean,
sample variance), so every group costs one partial row per map task; the
t statistic, the Welch-Satterthwaite degrees of freedom and the p-value are
evaluated afterwards on the aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moleval.functions.tdist import t_two_sided_p
from moleval.operators.common import as_list, col
from moleval.operators.filters import GOOD, OUTLIER

ALPHA = 0.05          # significance level of the report
STAR_OFFSET = 1.05    # star drawn 5% above the taller bar


def paired_ttest(pairs: DataFrame, by, a: str, b: str) -> DataFrame:
    """Paired t-test of a - b per group (two-sided).

    Output: n_pairs, mean_diff, t, df, p_value.  Fewer than two pairs or a
    zero variance give NULL t/p.
    """
    by = as_list(by)
    d = (col(a) - col(b)).alias("_d")
    agg = (pairs.select(*by, d).where(F.col("_d").isNotNull()).groupBy(*by)
           .agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("_d").alias("mean_diff"),
                F.stddev_samp("_d").alias("_sd")))
    se = F.col("_sd") / F.sqrt(F.col("n_pairs").cast("double"))
    t = F.when((F.col("n_pairs") >= 2) & (se > 0), F.col("mean_diff") / se)
    return (agg.withColumn("t", t)
               .withColumn("df", F.when(F.col("n_pairs") >= 2, (F.col("n_pairs") - 1).cast("double")))
               .withColumn("p_value", t_two_sided_p(F.col("t"), F.col("df")))
               .drop("_sd"))


def welch_from_moments(m1, v1, n1, m2, v2, n2):
    """t and Welch-Satterthwaite df from two samples' moments (Columns)."""
    a = v1 / n1
    b = v2 / n2
    se2 = a + b
    ok = (n1 >= 2) & (n2 >= 2) & (se2 > 0)
    t = F.when(ok, (m1 - m2) / F.sqrt(se2))
    dfree = F.when(ok, (se2 * se2) / ((a * a) / (n1 - 1) + (b * b) / (n2 - 1)))
    return t, dfree


def welch_ttest(df: DataFrame, by, feature: str, outcome: str = "outcome",
                first: str = GOOD, second: str = OUTLIER) -> DataFrame:
    """Welch (unequal variance) t-test of ``feature`` between the
    ``first`` and ``second`` outcome classes, per group, in one pass."""
    by = as_list(by)
    f = col(feature).cast("double")
    o = col(outcome)
    f1 = F.when(o == first, f)
    f2 = F.when(o == second, f)
    agg = df.groupBy(*by).agg(
        F.count(f1).alias("n_good"), F.avg(f1).alias("mean_good"), F.var_samp(f1).alias("_v1"),
        F.count(f2).alias("n_outlier"), F.avg(f2).alias("mean_outlier"), F.var_samp(f2).alias("_v2"))
    t, dfree = welch_from_moments(F.col("mean_good"), F.col("_v1"), F.col("n_good").cast("double"),
                                  F.col("mean_outlier"), F.col("_v2"), F.col("n_outlier").cast("double"))
    return (agg.withColumn("t", t).withColumn("df", dfree)
               .withColumn("p_value", t_two_sided_p(F.col("t"), F.col("df")))
               .drop("_v1", "_v2"))


def unpivot_features(df: DataFrame, ids, features) -> DataFrame:
    """Wide feature columns -> (ids..., property, value)."""
    ids = as_list(ids)
    return df.unpivot(ids, [F.col(c).cast("double").alias(c) for c in features], "property", "value")


def report_table(df: DataFrame, model: str, features, outcome: str = "outcome",
                 exclude=()) -> DataFrame:
    """Per (model, property): mean of the good and outlier rows
    (empty class -> 0), Welch p-value (NULL when a class has < 2 rows),
    ``significant`` (p < 0.05, NULL p -> false) and the star height.

    Models in ``exclude`` are left out (F9); the label keeps the text before
    ' ($' (P13).
    """
    base = df.where(~col(model).isin(list(exclude))) if exclude else df
    long = unpivot_features(base.select(col(model).alias("model"), col(outcome).alias("outcome"),
                                        *[col(c) for c in features]),
                            ["model", "outcome"], features)
    tests = welch_ttest(long, ["model", "property"], "value", "outcome")
    mg = F.coalesce(F.col("mean_good"), F.lit(0.0))
    mo = F.coalesce(F.col("mean_outlier"), F.lit(0.0))
    return tests.select(
        F.substring_index(F.col("model"), " ($", 1).alias("model"), "property",
        F.col("n_good"), F.col("n_outlier"),
        mg.alias("mean_good"), mo.alias("mean_outlier"),
        "t", "df", "p_value",
        F.coalesce(F.col("p_value") < ALPHA, F.lit(False)).alias("significant"),
        (F.greatest(mg, mo) * STAR_OFFSET).alias("star_y"))
