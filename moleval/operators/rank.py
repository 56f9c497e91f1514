"""Candidate leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moleval.functions.scalars import match_score
from moleval.operators.common import col, null_safe_join
from moleval.session import cut_lineage


def value_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """(value, rank): the rank of every distinct value, highest first, NULL last, where ties share a rank.

    Rows are counted per distinct value first, so a tie is one row however many
    rows have it.  The values are dealt out by range; a row's rank is 1, the
    rows of all higher ranges (one count per partition) and those above it in
    its own range, a window per partition.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    down = F.col(value).desc_nulls_last()
    v = cut_lineage(counts.repartitionByRange(down).withColumn("_pid", F.spark_partition_id()))
    before, rows = 0, []
    for r in sorted(v.groupBy("_pid").agg(F.sum("_c").alias("n")).collect()):    # one row per partition
        rows.append((r["_pid"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(rows, "_pid int, _before bigint")
    above = Window.partitionBy("_pid").orderBy(down).rowsBetween(Window.unboundedPreceding, -1)
    return v.join(offsets, "_pid").select(value, (F.col("_before") + F.coalesce(F.sum("_c").over(above), F.lit(0)) + 1).alias(name))


def leaderboard(trials: DataFrame, candidate: str, answer: str, pred: str, score=None) -> DataFrame:
    """Mean score of each candidate over its trial rows, best first.

    ``score`` is any Column over the trial row (U3); the default is
    ``-|answer - pred|`` (P14).  Output: candidate, n_trials, mean_score,
    rank (ties share a rank) and ``is_best`` (one row: highest mean, ties
    to the smallest candidate id).  Candidates are ranked in ranges of their
    means (:func:`value_ranks`), never in one task.
    """
    s = score if score is not None else match_score(col(answer), col(pred))
    agg = cut_lineage(trials.select(col(candidate).alias("candidate"), s.alias("_s"))
                      .groupBy("candidate").agg(F.count("_s").alias("n_trials"), F.avg("_s").alias("mean_score")))
    ranked = null_safe_join(agg, value_ranks(agg, "mean_score"), ["mean_score"], "left")
    # NULL is the smallest id
    best = ranked.where(F.col("rank") == 1).agg(F.min(F.struct(F.col("candidate").isNotNull().alias("some"), F.col("candidate").alias("id"))).alias("b")).select("b.id").scalar()
    return ranked.select("candidate", "n_trials", "mean_score", F.col("rank").cast("int").alias("rank"), ((F.col("rank") == 1) & F.col("candidate").eqNullSafe(best)).alias("is_best"))
