"""Pluggable user functions.

The studied code calls a remote model per row; here the user's callable
gets whole Arrow batches (a pandas Series of inputs) inside executors, so
batching and rate limiting live in the callable, and Spark partitions the work.
:func:`resume_predictions` keeps what was answered when a run ends early.  No
network access happens in this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleval.operators.common import as_list
from moleval.operators.ordered import identity_text
from moleval.session import cut_lineage
from moleval.sources.commits import append_batch, read_batches


def with_predictions(df: DataFrame, predict_fn: Callable[[pd.Series], pd.Series], input_col: str,
                     model: str, out: str = "pred", keep=None) -> DataFrame:
    """Run ``predict_fn`` (Series of inputs -> Series of numbers) over
    every partition with ``mapInPandas`` and label the rows with ``model``.
    ``keep`` are the columns carried through (default: all)."""
    keep = list(keep) if keep is not None else list(df.columns)
    src = df.select(*dict.fromkeys(keep + [input_col]))
    fields = [src.schema[c] for c in keep]
    schema = T.StructType([T.StructField("model", T.StringType(), False)] + fields
                          + [T.StructField(out, T.DoubleType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            res = pd.DataFrame({"model": model}, index=pdf.index)
            for c in keep:
                res[c] = pdf[c]
            res[out] = pd.to_numeric(pd.Series(predict_fn(pdf[input_col]), index=pdf.index),
                                     errors="coerce").astype("float64")
            yield res
    return src.mapInPandas(run, schema)


def with_descriptor(df: DataFrame, fn: Callable[[pd.Series], pd.Series], input_col: str,
                    out: str, return_type: str = "double", null_value=0) -> DataFrame:
    """Per-row descriptor computed by a vectorised user function (iterator
    pandas UDF); NULL input gives ``null_value``."""
    @F.pandas_udf(return_type)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            res = pd.Series(fn(s.fillna("")), index=s.index)
            yield res.where(s.notna(), null_value)
    return df.withColumn(out, udf(F.col(input_col)))


def with_model_predictions(df: DataFrame, predictors: dict, input_col, keep=None,
                           out: str = "pred") -> DataFrame:
    """U1 with dispatch by model name: one long table ``(model, keep..., pred)``
    for every ``{model: predict_fn}`` entry.  ``input_col`` is a column name,
    or a ``{model: column or Column}`` mapping when the models read different
    inputs (a direct prompt for one, an augmented prompt for another).

    One scan: every row is exploded into its (model, input) pairs, and one
    ``mapInPandas`` hands each model's rows of a batch to its callable.
    """
    keep = list(keep) if keep is not None else list(df.columns)
    inputs = {m: input_col[m] if isinstance(input_col, dict) else input_col for m in predictors}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("input"))
                                for m, c in inputs.items()]))
    src = df.select(*keep, pairs.alias("_p")).select(F.col("_p.model").alias("model"), *keep, F.col("_p.input").alias("_input"))
    schema = T.StructType([src.schema["model"], *[src.schema[c] for c in keep], T.StructField(out, T.DoubleType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pred = pd.Series(float("nan"), index=pdf.index, dtype="float64")
            for model, rows in pdf.groupby("model"):
                got = pd.Series(predictors[model](rows["_input"]), index=rows.index)
                pred.loc[rows.index] = pd.to_numeric(got, errors="coerce").astype("float64")
            res = pdf.drop(columns="_input")
            res[out] = pred
            yield res
    return src.mapInPandas(run, schema)


ANSWERS = "model string, key string, pred double, tries int, error string"


def _numbers(got, inputs: pd.Series) -> list:
    """The answers to ``inputs`` as floats, None where there is no number."""
    if not isinstance(got, (pd.Series, np.ndarray, list)):
        got = pd.Series(got, index=inputs.index)                # one answer for all, or answers by label
    elif isinstance(got, pd.Series) and got.index is not inputs.index and not got.index.equals(inputs.index):
        got = got.reindex(inputs.index)
    values = got if isinstance(got, list) else got.tolist()
    if len(values) != len(inputs):
        raise ValueError(f"{len(values)} answers to {len(inputs)} inputs")
    if not all(type(v) is float or type(v) is int for v in values):
        values = pd.to_numeric(pd.Series(values), errors="coerce").astype("float64").tolist()
    return [None if v != v else float(v) for v in values]


def _asked(predict_fn, inputs: pd.Series, max_tries: int) -> list[tuple]:
    """(pred, tries, error) per input.  A batch that fails is asked again, ``max_tries`` times in all; one
    that fails to the end is asked in halves, down to the rows that fail by themselves."""
    error, out, left = "", [], [(0, len(inputs))]
    while left:
        a, z = left.pop()
        part = inputs.iloc[a:z]
        for tries in range(1, max_tries + 1):
            try:
                out += [(p, tries, None) for p in _numbers(predict_fn(part), part)]
                break
            except Exception as e:  # noqa: BLE001   whatever the user's callable raises is a row of the report
                error = f"{type(e).__name__}: {e}"
        else:
            if z - a == 1:
                out.append((None, max_tries, error))
            else:
                half = (a + z) // 2
                left += [(half, z), (a, half)]
    return out


def resume_predictions(df: DataFrame, predict_fn: Callable[[pd.Series], pd.Series], input_col: str, model: str, path: str, key,
                       steps: int = 16, max_tries: int = 2) -> tuple[DataFrame, DataFrame]:
    """U1 over several runs: ``df`` with ``pred``, and the rows that failed with ``tries`` and ``error``.

    Answers land under ``path`` in committed batches, a ``steps``-th of the keys at a
    time, so a run that ends early loses one batch at most.  A later run asks only
    for keys without an answer (anti-join).  A NULL answer is an answer; an error is
    not, and is asked for again by the next run.  Rows of one key are asked once.
    """
    spark, key = df.sparkSession, as_list(key)
    keyed = df.withColumn("_key", identity_text(df, key))
    answered = read_batches(spark, path, ANSWERS).where((F.col("model") == model) & F.col("error").isNull()).select(F.col("key").alias("_key")).distinct()
    todo = keyed.groupBy("_key").agg(F.min(input_col).alias("_input")).join(answered, "_key", "left_anti")
    # asking costs by the row and not by the byte: as many tasks as the session shuffles to, however small the rows
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    todo = cut_lineage(todo.withColumn("_step", F.pmod(F.xxhash64("_key"), F.lit(steps))).repartition(tasks, "_key"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pred, tries, error = zip(*_asked(predict_fn, pdf["_input"], max_tries), strict=True)
                yield pd.DataFrame({"model": model, "key": pdf["_key"].tolist(), "pred": pd.Series(pred, dtype="float64"),
                                    "tries": pd.Series(tries, dtype="int32"), "error": pd.Series(error, dtype="object")})

    run = uuid.uuid4().hex
    counts = {r["_step"] for r in todo.groupBy("_step").count().collect()}          # ``steps`` rows at most
    for step in sorted(counts):
        append_batch(todo.where(F.col("_step") == step).mapInPandas(ask, ANSWERS), path, f"{run}-{step}")
    log = read_batches(spark, path, ANSWERS).where(F.col("model") == model)
    best = log.groupBy(F.col("key").alias("_key")).agg(F.max(F.col("error").isNull()).alias("_ok"), F.max(F.when(F.col("error").isNull(), F.nanvl("pred", F.lit(None)))).alias("pred"),
                                                       F.sum("tries").alias("tries"), F.max("error").alias("error"))
    joined = keyed.join(best, "_key")
    return joined.where("_ok").select(*df.columns, "pred"), joined.where(~F.col("_ok")).select(*df.columns, "tries", "error")
