"""Drain-and-stop runs of streaming queries (``trigger(availableNow=True)``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from moleval.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def run_available_now(stream: DataFrame, sink: str, checkpoint: str | None = None,
                      fmt: str = "parquet", partition_by=None) -> str:
    """Process everything available, write it to ``sink`` and stop.

    The checkpoint makes the run restartable: a re-run after a failure
    resumes from the last committed batch instead of reprocessing.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "ckpt")
    w = (stream.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    q = w.start(sink)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return sink
