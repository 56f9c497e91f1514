"""Joins (J1-J5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moleval.functions.prompt import NO_TABLE_TEXT, table_entry
from moleval.operators.common import as_list, col
from moleval.session import cut_lineage


def pair_with_base(long: DataFrame, base_model: str, key, model: str = "model",
                   value: str = "pred", base_value: str = "base_pred") -> DataFrame:
    """Every non-base model's rows paired with the base model's rows on
    ``key`` (inner join, duplicate keys multiply) -- one join for all models.
    """
    key = as_list(key)
    base = long.where(col(model) == base_model).select(*key, col(value).alias(base_value))
    others = long.where(col(model) != base_model)
    return others.join(base, key, "inner")


def semi_filter(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``."""
    return df.join(keys, as_list(on), "left_semi")


def first_match_lookup(probe: DataFrame, build: DataFrame, key: str, value: str,
                       order: str, name: str | None = None) -> DataFrame:
    """For every probe row, ``value`` of the first build row (in ``order``)
    with the same key.  The build side is reduced per key by ``min_by``
    (partially aggregated), then left-joined."""
    name = name or value
    first = build.groupBy(col(key).alias(key)).agg(
        F.min_by(col(value), col(order)).alias(name))
    return probe.join(first, key, "left")


def matched_values(df: DataFrame, groups: str, values: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """``df`` with ``_rid`` and ``_hits``: for each row the sorted entries of the
    value table whose name is in its group list, with ``times``, how often the
    list has the name.

    Works at any size of either side: the lists are reduced to (row, name,
    times), joined on the name and collected per row (bounded by the row's own
    list).  Row numbers are written once, so both uses of them agree.
    """
    rid = cut_lineage(df.withColumn("_rid", F.monotonically_increasing_id()))
    names = rid.select("_rid", F.explode(col(groups)).alias("_name")).groupBy("_rid", "_name").agg(F.count(F.lit(1)).alias("times"))
    entries = values.select(col(name).alias("_name"), *fields)
    hits = (names.join(entries, "_name").groupBy("_rid")
            .agg(F.array_sort(F.collect_list(F.struct(*fields, F.col("_name").alias("n"), "times"))).alias("_hits")))
    return rid.join(hits, "_rid", "left")


def attach_value_table(df: DataFrame, groups: str, values: DataFrame, name: str = "group",
                       value: str = "tpsa_contribution", rank: str = "rank", out: str = "data_table") -> DataFrame:
    """The value-table rows whose name is in the row's group list, once
    each, in value-table order, rendered as text entries; NULL groups give
    the literal 'No data required. '.  A name with several value rows keeps
    them all."""
    v = values.select(col(name).alias(name), col(rank).alias("r"), col(value).alias("v"))
    hit = matched_values(df, groups, v, name, ["r", "v"])
    table = F.transform(F.coalesce(F.col("_hits"), F.array()), lambda e: table_entry(e["n"], e["v"]))
    return (hit.withColumn(out, F.when(col(groups).isNull(), F.array(F.lit(NO_TABLE_TEXT))).otherwise(table))
            .drop("_rid", "_hits"))


def remap_codes(df: DataFrame, dim: DataFrame, code: str, name: str, out: str | None = None) -> DataFrame:
    """Replace a code by its name; an unknown code fails the job."""
    out = out or name
    joined = df.join(dim.select(col(code).alias(code), col(name).alias("_name")), code, "left")
    return joined.withColumn(out, F.when(F.col("_name").isNull(), F.raise_error(
        F.concat(F.lit("unknown code: "), col(code).cast("string")))).otherwise(F.col("_name"))).drop("_name")
