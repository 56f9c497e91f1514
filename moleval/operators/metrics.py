"""Error metrics, outcome counts, feature summaries and histograms (A1-A5, A10).

All aggregates are algebraic (count/sum/sum of squares) and therefore
partially aggregated before the shuffle; a hot model holding a third of the
rows costs one partial row per map task.  The only holistic statistic, the
median, uses the bucket counts of :func:`moleval.operators.common.exact_median`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moleval.operators.common import as_list, col, exact_median, null_safe_join
from moleval.operators.filters import GOOD, OUTLIER


def with_errors(df: DataFrame, calculated: str, pred: str,
                signed: str = "error", absolute: str = "abs_error") -> DataFrame:
    """Signed (pred - calculated) and absolute error columns."""
    return (df.withColumn(signed, col(pred) - col(calculated))
              .withColumn(absolute, F.abs(F.col(signed))))


def error_metrics(df: DataFrame, by, calculated: str, pred: str,
                  median: str = "exact", accuracy: int = 10000) -> DataFrame:
    """A1: n, RMSE, MAE and median of the signed error per group.

    Rows where either value is NULL or NaN are dropped first; a NULL group is
    a group of its own.
    ``median='exact'`` (default) is the midpoint median computed by rank
    selection; ``'approx'`` uses ``percentile_approx``; ``'inline'`` uses
    Spark's ``median`` aggregate (holds each group's values: small data only).
    """
    by = as_list(by)
    e = (col(pred) - col(calculated)).alias("_e")
    base = df.select(*by, e).where(F.col("_e").isNotNull() & ~F.isnan("_e"))
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
            F.avg(F.abs(F.col("_e"))).alias("mae")]
    if median == "approx":
        aggs.append(F.percentile_approx("_e", 0.5, accuracy).alias("median_error"))
    elif median == "inline":
        aggs.append(F.median("_e").alias("median_error"))
    elif median != "exact":
        raise ValueError("median must be 'exact', 'approx' or 'inline'")
    if median == "exact":
        # the moments come from the bucket sums of the first look
        out = exact_median(base, by, "_e", name="median_error",
                           sums={"_sq": F.col("_e") * F.col("_e"), "_abs": F.abs(F.col("_e"))})
        n = F.col("_n")
        return out.select(*by, n.alias("n"), F.sqrt(F.col("_sq") / n).alias("rmse"), (F.col("_abs") / n).alias("mae"), "median_error")
    return base.groupBy(*by).agg(*aggs)


def outcome_counts(df: DataFrame, by, outcome: str = "outcome") -> DataFrame:
    """A2: good / outlier / total per group; rows without a class count in
    neither (total = good + outlier, not count(*))."""
    by = as_list(by)
    o = col(outcome)
    return (df.groupBy(*by)
              .agg(F.count_if(o == GOOD).cast("bigint").alias("n_good"),
                   F.count_if(o == OUTLIER).cast("bigint").alias("n_outlier"))
              .withColumn("n_total", F.col("n_good") + F.col("n_outlier")))


def feature_summary(df: DataFrame, by, feature: str, ddof: int = 0) -> DataFrame:
    """A3/A4: mean and standard deviation of ``feature`` per group.

    ``ddof=0`` is the population deviation, ``ddof=1`` the sample one; NULL
    feature values are skipped.
    """
    by = as_list(by)
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    return (df.groupBy(*by)
              .agg(F.count(col(feature)).alias("n"),
                   F.avg(col(feature)).alias("mean"),
                   std(col(feature)).alias("std")))


def feature_summary_with_all(df: DataFrame, model: str, feature: str, outcome: str = "outcome",
                             all_models=(), ddof: int = 0, suffix: str = " (outlier)",
                             all_suffix: str = " (All)") -> DataFrame:
    """A5: outlier-only summaries per model next to all-rows summaries for
    ``all_models``, in one scan: every row is labelled with the groups it
    belongs to and the labels are exploded before one grouped aggregate."""
    m = col(model)
    labels = F.array_compact(F.array(
        F.when(col(outcome) == OUTLIER, F.concat(m, F.lit(suffix))),
        F.when(m.isin(list(all_models)), F.concat(m, F.lit(all_suffix))) if all_models else F.lit(None)))
    exploded = df.select(F.explode(labels).alias("label"), col(feature).alias(feature))
    return feature_summary(exploded, "label", feature, ddof)


def _numpy_bin(x, lo, hi, bins: int):
    """Bin number 1..bins exactly as numpy assigns values to the edges
    ``lo + i*(hi-lo)/bins``, last bin closed."""
    step = (hi - lo) / bins
    edge = lambda i: lo + i.cast("double") * step
    idx = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    idx = F.least(idx, F.lit(bins - 1))
    idx = F.when(x < edge(idx), idx - 1).otherwise(idx)
    idx = F.when((x >= edge(idx + 1)) & (idx != bins - 1), idx + 1).otherwise(idx)
    return idx + 1


def histogram(df: DataFrame, column: str, bins: int = 20, by=None) -> DataFrame:
    """A10: equal-width histogram over non-missing values.

    Every bin is present (empty ones with 0).  When min = max the range is
    widened by 0.5 on each side.  With no values at all the result is empty.
    Ranges are computed per group (``by``) by a partial aggregate; bin counts
    are a second partial aggregate, so nothing holds a group's values.
    """
    by = as_list(by)
    x = col(column).cast("double")
    vals = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    rng = (vals.groupBy(*by).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
           .select(*by,
                   F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                   F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
           .where(F.col("_lo").isNotNull()))          # F10: no values -> no histogram
    if by:
        joined = null_safe_join(vals, rng, by)
        all_bins = rng.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    else:                                   # one range: a scalar subquery, no join
        one = rng.select(F.struct("_lo", "_hi").alias("_r")).scalar()
        joined = vals.withColumn("_lo", one["_lo"]).withColumn("_hi", one["_hi"])
        all_bins = (df.sparkSession.range(1, bins + 1)
                    .select(one["_lo"].alias("_lo"), one["_hi"].alias("_hi"), F.col("id").cast("int").alias("bin"))
                    .where(F.col("_lo").isNotNull()))
    counted = (joined.select(*by, _numpy_bin(F.col("_x"), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
               .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count")))
    step = (F.col("_hi") - F.col("_lo")) / bins
    return (null_safe_join(all_bins, counted, by + ["bin"], "left")
            .select(*by, "bin",
                    (F.col("_lo") + (F.col("bin") - 1).cast("double") * step).alias("bin_lo"),
                    F.when(F.col("bin") == bins, F.col("_hi"))
                     .otherwise(F.col("_lo") + F.col("bin").cast("double") * step).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))

