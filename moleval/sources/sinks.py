"""Sinks (S7-S10); appends that are no second copy when repeated are in :mod:`moleval.sources.commits`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from moleval.sources.commits import append_batch, materialize_once, read_batches, source_fingerprint  # noqa: F401


def exists(spark: SparkSession, path: str) -> bool:
    """Path check through the Hadoop file system of the session (works for
    shared storage, not only local folders)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> None:
    """Write (overwrite by default); CSV gets a header."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> None:
    """Create an empty table with ``schema`` unless one exists."""
    spark.createDataFrame([], schema).write.mode("ignore").format(fmt).save(path)


def append_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append records to a log table (no read-modify-write).  A repeated call appends again;
    :func:`append_batch` does not."""
    df.write.mode("append").format(fmt).save(path)
