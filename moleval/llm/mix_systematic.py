"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every source gets a target of words (:func:`source_targets`); each of its
documents is expected ``target / source words`` times.  Within a source the
documents are ordered by (size, id), the expected copies are prefix-summed, a
random offset per source is added, and a document is emitted once for each
integer boundary that its share of the sum crosses.  As documents of like size
stand together, a source misses its target by about two longest documents at
most.

The prefix sum is taken in three levels (sizes of a source, splits of one size,
rows of a split), so no window holds more than the distinct sizes of a source
or ``1 / splits`` of the documents of one source and size.

Null texts and texts without words have size 0; a null source is a source of
its own, ordered last; a source without words has target 0; repeated rows are
documents of their own; an empty table gives an empty result.  Input columns
travel in one struct, so their names cannot clash with the ones made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moleval.llm.words import WORD_RE, fields

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SPLITS = 64
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(_k, _words) per source -> + _target.

    Weights go round the sources in code point order.  All words are shared by
    weight; a source stops at ``max_copies`` times its words and the excess
    goes to the others by weight.  Sources that fill up first have the smallest
    limit per weight, so one pass in that order finds the final level: the
    first prefix of full sources after which no other one is above its limit.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    rank = F.row_number().over(Window.orderBy("_k")) - 1
    s = sizes.withColumn("_w", F.element_at(w, (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", (F.col("_words") * max_copies).cast("double"))
    order = [F.col("_cap") / F.col("_w"), F.col("_k")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (s.withColumn("_cap0", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_w0", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
         .withColumn("_level", (F.sum("_words").over(everything) - F.col("_cap0"))
                     / (F.sum("_w").over(everything) - F.col("_w0"))))
    # levels only fall once one fits, so the first that fits is the largest of those
    s = s.withColumn("_final", F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(everything))
    full = F.col("_final").isNull() | (F.col("_cap") / F.col("_w") < F.col("_final"))
    return s.select("_k", "_words", F.when(full, F.col("_cap")).otherwise(F.col("_final") * F.col("_w")).alias("_target"))


def systematic_copies(docs: DataFrame, payload: list | None = None, doc_id: str = "doc_id", source: str = "source",
                      text: str = "text", weights=WEIGHTS, max_copies: int = MAX_COPIES,
                      splits: int = SPLITS, seed: int = SEED) -> DataFrame:
    """One row per input row: ``row`` (struct of the payload columns), ``size``,
    ``source_size``, ``target``, ``copies``."""
    payload = payload or docs.columns
    base = docs.select(
        fields(payload), F.col(doc_id).alias("_id"),
        F.coalesce(F.concat(F.lit("a"), F.col(source)), F.lit("b")).alias("_k"),
        word_count(F.col(text)).alias("size"),
        F.coalesce(F.pmod(F.col(doc_id).cast("bigint"), F.lit(splits)), F.lit(0)).cast("bigint").alias("_split"),
        F.xxhash64(text).alias("_tie"))
    keys = ["_k", "size", "_split"]
    pieces = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    by_size = pieces.groupBy("_k", "size").agg(F.sum("_n").alias("_n"))
    targets = source_targets(by_size.groupBy("_k").agg(F.sum(F.col("size") * F.col("_n")).alias("_words")),
                             weights, max_copies)
    upto = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    size_start = by_size.select("_k", "size", F.coalesce(F.sum("_n").over(upto("_k").orderBy("size")), F.lit(0)).alias("_before"))
    starts = (pieces.withColumn("_in", F.coalesce(F.sum("_n").over(upto("_k", "size").orderBy("_split")), F.lit(0)))
              .join(size_start, ["_k", "size"]).join(targets, "_k")
              .select(*keys, "_words", "_target", (F.col("_before") + F.col("_in")).alias("_start")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_id", "_tie"))
    each = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(F.lit(0.0))
    # a fixed fraction in [0, 1) of the seed and the source
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_k"))), 1, 8), 16, 10).cast("bigint")
              / F.lit(4294967296.0))
    at = F.col("_start") + F.col("_number")
    crossed = F.floor(at * F.col("_e") + F.col("_u")) - F.floor((at - 1) * F.col("_e") + F.col("_u"))
    return (base.withColumn("_number", number).join(starts, keys)
            .withColumns({"_e": each, "_u": offset})
            .select("row", "size", F.col("_words").alias("source_size"), F.col("_target").alias("target"),
                    crossed.cast("bigint").alias("copies")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the input rows, each as often as the sampling takes it."""
    plan = systematic_copies(docs, **options)
    return (plan.where("copies > 0").withColumn("_c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select("row.*"))
