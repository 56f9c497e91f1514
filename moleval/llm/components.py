"""Connected components of an edge table, and of small edge arrays inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moleval.session import cut_lineage

MAX_ROUNDS = 64


def union(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the classes of u[i] and v[i] in ``parent`` (smallest number is the root)."""
    while True:
        pu, pv = parent[u], parent[v]
        differ = pu != pv
        if not differ.any():
            return
        u, v, pu, pv = u[differ], v[differ], pu[differ], pv[differ]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Alternating large-star and small-star steps: every node links its larger
    neighbours, then its smaller ones, to the smallest of them, until the edges
    are stars.  A step is a grouped minimum (combined before the shuffle) and a
    join, so a hub's edges are never gathered; each round is written to the
    checkpoint folder.  Null ends and self edges are ignored.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return (e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    e = cut_lineage(tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    now = state(e)
    for _ in range(MAX_ROUNDS):
        if now[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low, "u")
        small = tidy(step.select("u", F.col("m").alias("v")).union(step.select(F.col("v").alias("u"), F.col("m").alias("v"))))
        e, before = cut_lineage(small), now
        now = state(e)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
