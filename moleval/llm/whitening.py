"""Whitening of embeddings with MLlib's distributed ``BlockMatrix``.

Vectors are put on a grid of whole numbers, centred exactly (``n * x - S`` in
whole numbers, divided once), indexed and laid out in blocks of rows.  The block
matrix times its transpose gives the scatter, summed over splits of the rows; its
covariance (dimension x dimension, the one thing the driver gets) is decomposed
there, and the block matrix times the whitening matrix projects all rows.  A
second transpose product over the projected rows measures how far their
covariance is from the identity.

Left out of the fit and of the result: null vectors, vectors with a null, NaN or
infinite entry or one whose grid value passes 2^52, and vectors of another length
than most have (ties: the longer).  Repeated rows count as often as they stand and
get equal values; directions without variance (eigenvalue up to 1e-10 of the
largest) have no component, so a table of equal vectors, one row or none gives an
empty result.  Equal eigenvalues are numbered as the decomposition returns them.
Sums that pass 64 bits raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moleval.llm.words import fields
from moleval.session import cut_lineage

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
BLOCK_BYTES = 32 << 20          # of one block of rows at most
BLOCKS_PER_SPLIT = 4            # row blocks multiplied by one task of a transpose product
LEAST = 1e-10                   # of the largest eigenvalue


def on_grid(df: DataFrame, vector: str, keep: list[str], scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(row, x): the kept columns, and ``floor(scale * entry) + shift`` of every usable vector."""
    c = F.transform(F.col(vector), lambda v: v.cast("double") * F.lit(float(scale)))
    # comparisons with NaN: it is above every number
    usable = F.forall("c", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float(1 << 52))))
    return (df.select(fields(keep), c.alias("c")).where(F.col("c").isNotNull() & usable)
            .select("row", F.transform("c", lambda v: F.floor(v) + F.lit(shift).cast("bigint")).alias("x")))


def indexed(df: DataFrame) -> DataFrame:
    """The rows with an ``index`` from 0 on, numbered inside their partitions and shifted by those before; written once."""
    d = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = d.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return d.withColumn("_part", part).join(offsets, "_part").withColumn("index", F.col("_before") + place).drop("_part", "_before", "_id")


def blocks_of(rows: DataFrame, n: int, dim: int, rows_per_block: int) -> BlockMatrix:
    """Block matrix of (index, v) rows with ``v`` array<double>."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("index").cast("bigint"), array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, n, dim).toBlockMatrix(rows_per_block, dim)


def product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``a`` times ``b``; ``splits`` tasks share the middle dimension (an argument that the Python method leaves at 1)."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def scatter(m: BlockMatrix, n_blocks: int) -> np.ndarray:
    """Transpose times matrix, as one local array of columns x columns."""
    return np.array(product(m.transpose(), m, max(1, -(-n_blocks // BLOCKS_PER_SPLIT))).toLocalMatrix().toArray())


def local_block(sc, a: np.ndarray) -> BlockMatrix:
    """A small matrix as a block matrix of one block."""
    return BlockMatrix(sc.parallelize([((0, 0), DenseMatrix(*a.shape, a.ravel(order="F").tolist()))], 1), *a.shape)


@dataclass
class Whitened:
    """``rows``: row, x, deviation, whitened (array); ``explained``: each component's share of the variance;
    ``vectors``: the components, as columns; ``identity_error``: largest entry of whitened's covariance minus the identity."""
    rows: DataFrame
    n: int
    explained: list[float]
    vectors: np.ndarray
    identity_error: float


def whiten(df: DataFrame, vector: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT, rows_per_block: int | None = None) -> Whitened:
    """Whiten the usable vectors of ``df`` along at most ``components`` directions of most variance."""
    spark = df.sparkSession
    sc = spark.sparkContext
    grid = on_grid(df, vector, keep if keep is not None else [c for c in df.columns if c != vector], scale, shift)
    all_rows = indexed(grid.withColumn("dim", F.size("x")))
    lengths = all_rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    dim, n = (lengths[0].dim, lengths[0].n) if lengths else (0, 0)
    if not dim:
        return _none(all_rows, n, dim)
    if all_rows.where(F.col("dim") != dim).limit(1).count():
        all_rows = indexed(all_rows.where(F.col("dim") == dim).drop("index"))
    sums = [int(s) for s in all_rows.agg(*[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dim)]).first()]
    total = F.array(*[F.lit(s).cast("bigint") for s in sums])
    off = all_rows.withColumn("y", F.zip_with("x", total, lambda a, s: a * F.lit(n).cast("bigint") - s))
    per = rows_per_block or max(256, min(BLOCK_BYTES // (8 * dim), -(-n // (4 * sc.defaultParallelism))))
    n_blocks = -(-n // per)
    # both matrices are read twice; a lost copy is made again from the written rows
    centred = blocks_of(off.select("index", F.transform("y", lambda v: v.cast("double") / F.lit(float(n))).alias("v")), n, dim, per).persist(StorageLevel.MEMORY_AND_DISK)
    v = scatter(centred, n_blocks) / n
    value, vec = np.linalg.eigh((v + v.T) / 2)
    order = [i for i in np.argsort(-value, kind="stable")[:components] if value[i] > LEAST * value.max()]
    if not order:
        _free(centred)
        return _none(all_rows, n, dim)
    projected = product(centred, local_block(sc, vec[:, order] / np.sqrt(value[order]))).persist(StorageLevel.MEMORY_AND_DISK)
    error = float(np.abs(scatter(projected, n_blocks) / n - np.eye(len(order))).max())
    back = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    back = cut_lineage(back.select("index", vector_to_array("vector").alias("whitened")))
    _free(centred)
    _free(projected)
    square = lambda y: y.cast("decimal(18,0)") * y.cast("decimal(18,0)")
    deviation = F.aggregate("y", F.lit(0).cast("decimal(38,0)"), lambda s, y: (s + square(y)).cast("decimal(38,0)"))
    rows = off.select("index", "row", "x", deviation.alias("deviation")).join(back, "index").drop("index")
    return Whitened(rows, n, (value[order] / np.trace(v)).tolist(), vec[:, order], error)


def _free(m: BlockMatrix) -> None:
    m._java_matrix_wrapper.call("blocks").unpersist(False)


def _none(rows: DataFrame, n: int, dim: int) -> Whitened:
    empty = rows.where(F.lit(False)).select("row", "x", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    return Whitened(empty, n, [], np.zeros((dim, 0)), 0.0)


def long_form(w: Whitened) -> DataFrame:
    """A row per vector and component (numbered from 1)."""
    shares = F.array(*[F.lit(e) for e in w.explained]).cast("array<double>")
    d = w.rows.select("row", F.lit(w.n).cast("bigint").alias("n"), F.col("deviation").cast("bigint").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return d.select("row", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"),
                    F.lit(w.identity_error).cast("double").alias("identity_error"))
