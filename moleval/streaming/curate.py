"""ST3: continuous curation of landed API responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from moleval.operators.curate import curate

RESPONSE_SCHEMA = T.StructType([
    T.StructField("chunk", T.LongType()),
    T.StructField("cid_list", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("body", T.StringType()),
])


def curate_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None,
                  allowed=("C", "N", "O"), limits: dict | None = None) -> DataFrame:
    """Streaming curation: landed JSON-lines responses ``(chunk, cid_list,
    status, body)`` -> parse (S5) -> SMILES present (F5) -> alphabet (P17)
    -> range exclusions (F4).  Stateless, so every micro-batch is independent;
    the size cap (F7) stays a batch step on the sink."""
    r = spark.readStream.schema(RESPONSE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return curate(r.json(landing_dir), allowed=allowed, limits=limits)
