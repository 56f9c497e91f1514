"""Bindings for splitting, candidate ranking and user-function operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from moleval.operators import predict as P
from moleval.operators import rank as RK
from moleval.operators import split as SP
from moleval.plans.testdata import table


def q_group_split_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return SP.group_split(d, "source", 0.8)


def q_group_split_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return SP.group_split(o, "o_custkey", 0.8)


def _sql_greedy(tbl: str, key: str, cols: str) -> str:
    return f"""
WITH RECURSIVE g AS (SELECT {key} AS k, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {key}) AS rn
                     FROM {tbl} GROUP BY {key}),
cap AS (SELECT CAST(floor(sum(n) * 0.8 + 1e-9) AS BIGINT) AS c FROM g),
r AS (SELECT rn, k, n, CASE WHEN n <= c THEN n ELSE 0 END AS used, n <= c AS is_train FROM g, cap WHERE rn = 1
      UNION ALL
      SELECT g.rn, g.k, g.n, CASE WHEN r.used + g.n <= c THEN r.used + g.n ELSE r.used END,
             r.used + g.n <= c
      FROM r JOIN g ON g.rn = r.rn + 1, cap)
SELECT {cols}, CASE WHEN r.is_train THEN 'train' ELSE 'test' END AS split
FROM {tbl} JOIN r ON {tbl}.{key} = r.k"""


SQL_GROUP_SPLIT_DOCS = _sql_greedy("documents", "source", "doc_id, source")
SQL_GROUP_SPLIT_ORDERS = _sql_greedy("orders", "o_custkey", "o_orderkey, o_custkey")


def q_leaderboard(spark, sf_dir):
    """candidate = event type; answer = the event value; prediction =
    the user's mean value; score -|answer - prediction|."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    means = ev.groupBy("user_id").agg(F.avg("value").alias("user_mean"))
    trials = ev.join(means, "user_id")
    lb = RK.leaderboard(trials, "event_type", "value", "user_mean")
    return lb.select("candidate", F.col("n_trials").cast("bigint").alias("n_trials"),
                     (F.round("mean_score", 6) + F.lit(0.0)).alias("mean_score"),
                     F.col("rank").cast("int").alias("rank"), "is_best")


SQL_LEADERBOARD = """
WITH m AS (SELECT user_id, avg(value) AS user_mean FROM events GROUP BY user_id),
a AS (SELECT event_type AS candidate, count(*) AS n, avg(-abs(value - user_mean)) AS s
      FROM events JOIN m USING (user_id) GROUP BY event_type)
SELECT candidate, CAST(n AS BIGINT) AS n_trials, round(s, 6) + 0.0 AS mean_score,
       CAST(rank() OVER (ORDER BY s DESC NULLS LAST) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY s DESC NULLS LAST, candidate) = 1 AS is_best
FROM a"""


def text_length_predictor(texts: pd.Series) -> pd.Series:
    """Deterministic stand-in for a model: characters / 100."""
    return texts.str.len() / 100.0


def uppercase_count(texts: pd.Series) -> pd.Series:
    return texts.str.count(r"[A-Z]").astype("float64")


def q_udf_predict(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = P.with_predictions(d, text_length_predictor, "text", "length_model", keep=["doc_id"])
    return p.select("model", "doc_id", F.round("pred", 6).alias("pred"))


SQL_UDF_PREDICT = "SELECT 'length_model' AS model, doc_id, round(length(text) / 100.0, 6) AS pred FROM documents"


def q_udf_descriptor(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return P.with_descriptor(d, uppercase_count, "text", "n_upper").select("doc_id", "n_upper")


SQL_UDF_DESCRIPTOR = """
SELECT doc_id, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS DOUBLE) AS n_upper FROM documents"""

QUERIES = {
    "group_split_docs": q_group_split_docs,
    "group_split_orders": q_group_split_orders,
    "leaderboard": q_leaderboard,
    "udf_predict": q_udf_predict,
    "udf_descriptor": q_udf_descriptor,
}

ORACLE_SQL = {
    "group_split_docs": SQL_GROUP_SPLIT_DOCS,
    "group_split_orders": SQL_GROUP_SPLIT_ORDERS,
    "leaderboard": SQL_LEADERBOARD,
    "udf_predict": SQL_UDF_PREDICT,
    "udf_descriptor": SQL_UDF_DESCRIPTOR,
}

