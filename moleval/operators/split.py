"""Leak-free group split.

Rows sharing a group key always land on the same side.  The greedy rule
(groups by size descending, ties by key; a group goes to ``train`` when it
still fits into ``floor(frac * N)`` rows) is sequential over groups, but
only over *distinct group sizes*: all groups of one size form a run, and a
run takes ``min(count, floor(room / size))`` groups.  Distinct sizes are at
most ``sqrt(2N)`` (their sum is at most N) and are read one by one.

All sizes above the first run that does not fit are whole, so one comparison
decides them.  Below it the room is less than that size, and so is the sum of the
sizes taken from there on: they are at most ``sqrt(2 * size)``, a bounded table.  A
run taken in part leaves a remainder, at most half the room before, so few runs
are; only their groups are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moleval.operators.common import as_list, col, null_safe_join, with_sequence_index
from moleval.session import cut_lineage

TRAIN = "train"
TEST = "test"


@dataclass(frozen=True)
class Runs:
    """Sizes above ``whole_above`` are all train; ``taken`` has (size, groups taken) of the others with any, ``partly`` those not whole."""
    whole_above: int
    taken: list[tuple[int, int]]
    partly: list[int]


def walk_sizes(sizes, room: int) -> Runs:
    """Decide (size, number of groups) runs, largest size first."""
    whole_above, taken, partly, full = 0, [], [], False
    for size, count in sizes:
        take = min(count, room // size)
        room -= take * size
        if not full and take < count:
            full, whole_above = True, size
        if full and take:
            taken.append((size, take))
            if take < count:
                partly.append(size)
    return Runs(whole_above, taken, partly)


def group_assignment(df: DataFrame, key, frac: float = 0.8) -> DataFrame:
    """Per group key: ``(key..., size, split)`` following the greedy rule."""
    key = as_list(key)
    sizes = cut_lineage(df.groupBy(*[col(k) for k in key]).agg(F.count(F.lit(1)).alias("size")))
    cap = sizes.agg(F.floor(F.sum("size") * frac + 1e-9).cast("bigint")).first()[0] or 0
    runs = walk_sizes(((r["size"], r["count"]) for r in sizes.groupBy("size").count().orderBy(F.desc("size")).toLocalIterator()), cap)
    spark = df.sparkSession
    ranked = with_sequence_index(sizes.where(F.col("size").isin(runs.partly)), [F.col("size").desc(), *[F.col(k) for k in key]], name="_seq")
    first = ranked.groupBy("size").agg(F.min("_seq").alias("_first"))
    taken = F.broadcast(spark.createDataFrame(runs.taken, "size bigint, taken bigint"))
    in_part = (ranked.join(F.broadcast(first), "size").join(taken, "size")
               .withColumn("train", F.col("_seq") - F.col("_first") < F.col("taken")).select(*key, "size", "train"))
    rest = sizes.where(~F.col("size").isin(runs.partly)).join(taken, "size", "left")
    whole = rest.select(*key, "size", ((F.col("size") > runs.whole_above) | F.col("taken").isNotNull()).alias("train"))
    return whole.unionByName(in_part).select(*key, "size", F.when(F.col("train"), F.lit(TRAIN)).otherwise(F.lit(TEST)).alias("split"))


def group_split(df: DataFrame, key, frac: float = 0.8, method: str = "greedy",
                seed: int = 42, name: str = "split") -> DataFrame:
    """Add ``split`` ('train' / 'test') so that no key is on both sides.
    NULL is a key like any other.

    ``method='greedy'``: the size-ordered first-fit rule (exact train size
    bound); ``method='hash'``: ``pmod(xxhash64(key, seed), 10000) <
    frac*10000`` -- no shuffle at all, expected (not exact) fraction.
    """
    key = as_list(key)
    if method == "hash":
        h = F.pmod(F.xxhash64(*[col(k) for k in key], F.lit(seed)), F.lit(10000))
        return df.withColumn(name, F.when(h < int(frac * 10000), F.lit(TRAIN)).otherwise(F.lit(TEST)))
    if method != "greedy":
        raise ValueError("method must be 'greedy' or 'hash'")
    assign = group_assignment(df, key, frac).select(*key, F.col("split").alias(name))
    return null_safe_join(df, assign, key, "left")
