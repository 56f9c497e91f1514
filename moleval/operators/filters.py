"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moleval.operators.common import as_list, col

GOOD = "good"
OUTLIER = "outlier"


def drop_missing(df: DataFrame, subset) -> DataFrame:
    """drop rows with NULL in any of ``subset``."""
    return df.dropna(subset=as_list(subset))


def drop_extreme(df: DataFrame, column: str, limit: float = 1000.0) -> DataFrame:
    """keep rows with ``column < limit`` (strict; NULL rows are dropped)."""
    return df.where(col(column) < limit)


def error_class(error, threshold: float = 1.0):
    """F3 as a Column: 'outlier' when error > t, 'good' when <= t, NULL when
    the error is missing (such rows fall in neither partition)."""
    e = col(error)
    return F.when(e > threshold, F.lit(OUTLIER)).when(e <= threshold, F.lit(GOOD))


def partition_by_error(df: DataFrame, calculated: str, pred: str, threshold: float = 1.0,
                       error_name: str = "abs_error", class_name: str = "outcome") -> DataFrame:
    """add |calculated - pred| and its good/outlier class."""
    e = F.abs(col(calculated) - col(pred))
    return df.withColumn(error_name, e).withColumn(class_name, error_class(F.col(error_name), threshold))


def exclude_above(df: DataFrame, limits: dict) -> DataFrame:
    """drop rows where ``column > limit`` is true; missing values stay."""
    cond = F.lit(True)
    for c, k in limits.items():
        cond = cond & ~F.coalesce(col(c) > k, F.lit(False))
    return df.where(cond)


def require_present(df: DataFrame, column: str) -> DataFrame:
    """key-presence filter."""
    return df.where(col(column).isNotNull())


def accept_tagged(df: DataFrame, groups: str = "groups") -> DataFrame:
    """keep rows whose tagging succeeded (conflict/invalid -> NULL)."""
    return df.where(col(groups).isNotNull())


def cap_rows(df: DataFrame, arrival: list, target: int) -> DataFrame:
    """the first ``target`` rows in arrival order (top-k, bounded)."""
    return df.orderBy(*[col(c) for c in arrival]).limit(target)


def until_first_failure(chunks: DataFrame, chunk: str = "chunk", ok=None) -> DataFrame:
    """F8: chunks read in order, stopping at the first failed one.

    ``ok`` is a boolean Column (default: ``status = 200``).  Keeps chunks
    strictly before the first not-ok chunk.
    """
    ok = F.coalesce(ok if ok is not None else (F.col("status") == 200), F.lit(False))
    first_bad = chunks.where(~ok).agg(F.min(col(chunk))).scalar()     # scalar subquery
    return chunks.where(first_bad.isNull() | (col(chunk) < first_bad))


def exclude_values(df: DataFrame, column: str, values) -> DataFrame:
    """drop rows whose ``column`` is one of ``values``."""
    return df.where(~col(column).isin(list(values)))
