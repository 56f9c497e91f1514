"""Student-t two-sided p-value as a native Spark expression (P-T).

With ``theta = atan(t / sqrt(df))`` the t density becomes ``cos(theta)^(df-1)``
up to a constant, so

    p = int_{theta0}^{U} cos^(df-1) / int_0^{U0} cos^(df-1),   theta0 = atan(|t|/sqrt(df))

Both integrals are evaluated with composite Simpson over ``PANELS`` panels
inside ``aggregate(sequence(0, PANELS), ...)``.  For large df the mass sits
near zero, so both upper limits are cut to ``atan((|t| + TAIL)/sqrt(df))``
and ``atan(TAIL/sqrt(df))`` (the mass beyond ``TAIL`` is below 1e-300).
The expression is evaluated on aggregated rows (one per model/property),
never per input row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PANELS = 2000          # even number of Simpson panels
CUT_DF = 200.0         # above this df the integration range is truncated
TAIL = 40.0


def _simpson(lo: Column, hi: Column, expo: Column) -> Column:
    h = (hi - lo) / PANELS

    def step(acc, i):
        w = F.when((i == 0) | (i == PANELS), F.lit(1.0)).when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0))
        x = lo + i.cast("double") * h
        return acc + (w * F.pow(F.greatest(F.cos(x), F.lit(0.0)), expo))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(PANELS)), F.lit(0.0), step)
    return (total * h) / 3.0


def t_two_sided_p(t, df) -> Column:
    """P(|T_df| >= |t|); NULL when t or df is NULL/NaN or df < 1."""
    t = F.col(t) if isinstance(t, str) else t
    df = F.col(df) if isinstance(df, str) else df
    at = F.abs(t)
    sq = F.sqrt(df)
    theta0 = F.atan(at / sq)
    half_pi = F.lit(math.pi / 2)
    big = df > CUT_DF
    upper = F.when(big, F.atan((at + TAIL) / sq)).otherwise(half_pi)
    upper0 = F.when(big, F.atan(F.lit(TAIL) / sq)).otherwise(half_pi)
    expo = df - 1.0
    num = _simpson(theta0, F.greatest(upper, theta0), expo)
    den = _simpson(F.lit(0.0), upper0, expo)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), num / den))
    valid = t.isNotNull() & df.isNotNull() & ~F.isnan(t) & ~F.isnan(df) & (df >= 1.0)
    return F.when(valid, p)


def t_two_sided_p_sql(t: str, df: str) -> str:
    """The same quadrature as DuckDB SQL text (used by the oracle queries)."""
    n = PANELS

    def simpson(lo: str, hi: str, expo: str) -> str:
        h = f"(({hi}) - ({lo})) / {n}.0"
        w = f"(CASE WHEN i = 0 OR i = {n} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
        body = f"{w} * pow(greatest(cos(({lo}) + i * {h}), 0.0), {expo})"
        return (f"((list_sum(list_transform(range(0, {n} + 1), lambda i: {body})) * {h}) / 3.0)")

    at = f"abs({t})"
    sq = f"sqrt({df})"
    theta0 = f"atan({at} / {sq})"
    upper = f"(CASE WHEN {df} > {CUT_DF} THEN atan(({at} + {TAIL}) / {sq}) ELSE pi() / 2 END)"
    upper0 = f"(CASE WHEN {df} > {CUT_DF} THEN atan({TAIL} / {sq}) ELSE pi() / 2 END)"
    expo = f"({df} - 1.0)"
    num = simpson(theta0, f"greatest({upper}, {theta0})", expo)
    den = simpson("0.0", upper0, expo)
    return (f"(CASE WHEN {t} IS NOT NULL AND {df} IS NOT NULL AND NOT isnan({t}) AND NOT isnan({df}) "
            f"AND {df} >= 1.0 THEN least(1.0, greatest(0.0, {num} / {den})) END)")
