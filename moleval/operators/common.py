"""Small building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moleval.session import cut_lineage

def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (list, tuple)):
        return list(x)
    return [x]


def null_safe_join(left: DataFrame, right: DataFrame, on: list, how: str = "inner") -> DataFrame:
    """Join on columns of the same names where NULL equals NULL; the columns
    appear once (from ``left``)."""
    renamed = right.select(*[F.col(c).alias(f"_on_{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & left[c].eqNullSafe(renamed[f"_on_{i}"])
    return left.join(renamed, cond, how).drop(*[f"_on_{i}" for i in range(len(on))])


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_sequence_index(df: DataFrame, order: list, name: str = "seq",
                        num_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """Global 0-based position of every row in ``order`` (ties broken arbitrarily).

    Works without moving all rows to one partition: rows are range
    partitioned on the order key (a hot key value is spread over several
    partitions), sorted inside each partition, numbered locally, and shifted
    by the row count of all earlier partitions.  The offset table has one row
    per partition, so its broadcast is bounded by ``num_partitions``.

    ``repartitionByRange`` with an explicit count is never coalesced by AQE.
    The range bounds come from sampling the input, so when the input order
    is not deterministic (rows coming out of a shuffle) two evaluations could
    cut the ranges differently; the numbered rows are therefore written once
    with a reliable checkpoint (``materialize=True``) and both the partition
    counts and the final rows read that copy, which also survives the loss
    of an executor.
    """
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    keys = [col(c) for c in order]
    srt = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_local", F.monotonically_increasing_id()
                       - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    if materialize:
        srt = cut_lineage(srt)
    counts = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (srt.join(F.broadcast(offsets), "_pid")
            .select(*[F.col(c) for c in df.columns], (F.col("_off") + F.col("_local")).alias(name)))


PARTS_PER_OCTAVE = 1024


def value_bucket(v) -> Column:
    """Whole number that never falls as ``v`` grows: sign, then the octave of
    |v| cut into ``PARTS_PER_OCTAVE`` parts (0 for 0)."""
    v = col(v)
    octave = F.least(F.greatest(F.log2(F.abs(v)), F.lit(-1100.0)), F.lit(1100.0))
    size = F.floor((octave + 1101) * PARTS_PER_OCTAVE).cast("bigint")
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("bigint"))


def exact_median(df: DataFrame, by: list, value: str, name: str = "median", sums: dict | None = None) -> DataFrame:
    """Exact median per group (midpoint of the two middle values for even n),
    with the row count ``_n`` and further ``sums`` (name -> Column) per group.

    Two looks at the rows, both combined before the shuffle: counts (and sums)
    per (group, :func:`value_bucket`), which tell the one or two buckets that
    hold the middle ranks; then counts per distinct value inside those buckets.
    Ties are one distinct value, so a hot value costs one row per task; no raw
    row is sorted or shuffled.  NULL groups are groups; NULL and NaN values
    are left out.
    """
    by = as_list(by)
    base = df.where(col(value).isNotNull() & ~F.isnan(value)).withColumn("_b", value_bucket(value))
    counts = base.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()])
    group = Window.partitionBy(*by)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"_n": F.sum("_c").over(group), "_upto": F.sum("_c").over(upto)})
    first, last = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    # ranks are 0-based; a bucket holds [_upto - _c, _upto)
    middle = (ranked.withColumn("_before", F.col("_upto") - F.col("_c"))
              .where((F.col("_before") <= last) & (F.col("_upto") > first)).select(*by, "_b", "_n", "_before"))
    values = (null_safe_join(base.select(*by, "_b", value), middle, by + ["_b"])
              .groupBy(*by, "_b", "_n", "_before", value).agg(F.count(F.lit(1)).alias("_c")))
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = values.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside)).withColumn("_from", F.col("_upto") - F.col("_c"))
    holds = lambda r: (F.col("_from") <= r) & (F.col("_upto") > r)
    med = at.groupBy(*by).agg(((F.max(F.when(holds(first), F.col(value))) + F.max(F.when(holds(last), F.col(value)))) / 2).alias(name))
    total = counts.groupBy(*by).agg(F.sum("_c").alias("_n"), *[F.sum(n).alias(n) for n in sums or {}])
    return null_safe_join(total, med, by) if by else total.withColumn(name, med.scalar())
