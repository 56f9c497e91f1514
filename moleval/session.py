"""Spark session set-up and lineage cutting.

The library never creates a session behind the user's back: every operator
takes DataFrames and derives its session from them.  ``get_session`` is a
convenience for scripts, tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(master: str | None = None, app: str = "moleval",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    AQE is on so that small derived tables (per-group statistics, distinct
    sizes, partition offsets) are broadcast by the runtime size check and
    skewed shuffle partitions are split.  The web UI stays off.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared file system; only a local
    master (tests, benchmark) gets a private temporary folder when unset.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; point it at a shared folder")
        current = tempfile.mkdtemp(prefix="moleval-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_CONF, current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder).

    Used where a plan is reused by several jobs, so that a lost executor
    recomputes from the written copy instead of the whole lineage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
