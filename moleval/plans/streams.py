"""Streaming bindings: each query drains a file stream built from a test
table (``trigger(availableNow=True)``) into a sink under the shared
checkpoint folder and returns the sink read back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from moleval.plans import landed as LD
from moleval.plans import testdata as TD
from moleval.streaming.curate import curate_stream
from moleval.streaming.dedup import recent_dedup_stream
from moleval.streaming.route import route_examples
from moleval.streaming.runner import run_available_now, scratch_path


FILES_PER_TRIGGER = 64         # bounds what a micro-batch sorts per key


def _event_stream(spark, sf_dir):
    schema = TD.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option(
        "maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(sf_dir)


def _dedup(spark, sf_dir):
    ev = _event_stream(spark, sf_dir).select(
        "user_id", "event_id", "ts", F.floor("value").cast("bigint").alias("k"),
        (F.col("value") - 50.0).alias("err"))
    return recent_dedup_stream(ev, "user_id", ["ts", "event_id"], "k", error="err", window=5,
                               max_err=20.0, keep=["event_id"])


def q_stream_dedup(spark, sf_dir):
    sink = run_available_now(_dedup(spark, sf_dir), scratch_path(spark, "stream-dedup"))
    return spark.read.parquet(sink).select("user_id", "event_id", "outcome")


def q_stream_dedup_shuffled(spark, sf_dir):
    """ST1 by event time: events landed in files without any order, one file per micro-batch, and last a
    row far ahead that lets the watermark pass them all."""
    landing = scratch_path(spark, "shuffled-events")
    events = TD.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{landing}/events")
    ahead = events.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("bigint").alias("event_id"),
                                                       (F.col("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit(None).cast("double").alias("value"))
    ahead.write.parquet(f"{landing}/mark")
    s = (spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
         .option("maxFilesPerTrigger", 1).parquet(landing))
    ev = s.select("user_id", "event_id", "ts", F.floor("value").cast("bigint").alias("k"), (F.col("value") - 50.0).alias("err"))
    d = recent_dedup_stream(ev, "user_id", ["ts", "event_id"], "k", error="err", window=5, max_err=20.0, keep=["event_id"],
                            event_time="ts", delay="60 days", bucket_ms=10 * 86_400_000)
    sink = run_available_now(d, scratch_path(spark, "stream-shuffled"))
    return spark.read.parquet(sink).where("event_id IS NOT NULL").select("user_id", "event_id", "outcome")


def q_stream_route(spark, sf_dir):
    acc, rej = scratch_path(spark, "accepted"), scratch_path(spark, "rejected")
    q = route_examples(_dedup(spark, sf_dir), acc, rej, scratch_path(spark, "ckpt"))
    q.awaitTermination()
    a = spark.read.parquet(acc).select("user_id", "event_id", F.lit("accepted").alias("log"))
    r = spark.read.parquet(rej).select("user_id", "event_id", F.lit("rejected").alias("log"))
    return a.unionByName(r)


SQL_STREAM_ROUTE = ("SELECT user_id, event_id, outcome AS log FROM (" + TD.SQL_RECENT_DEDUP.replace(
    "WITH RECURSIVE", "WITH RECURSIVE", 1) + ") WHERE outcome IN ('accepted', 'rejected')")


def q_stream_curate(spark, sf_dir):
    landing = scratch_path(spark, "landing")
    LD.property_responses(spark, sf_dir).write.mode("overwrite").json(landing)
    cur = curate_stream(spark, landing)
    sink = run_available_now(cur, scratch_path(spark, "curated"))
    c = spark.read.parquet(sink)
    return c.select("CID", "CanonicalSMILES", F.round("ExactMass", 6).alias("ExactMass"),
                    "HBondDonorCount", "HBondAcceptorCount")


QUERIES = {
    "stream_dedup": q_stream_dedup,
    "stream_dedup_shuffled": q_stream_dedup_shuffled,
    "stream_route": q_stream_route,
    "stream_curate": q_stream_curate,
}

ORACLE_SQL = {
    "stream_dedup": TD.SQL_RECENT_DEDUP,
    "stream_dedup_shuffled": TD.SQL_RECENT_DEDUP,
    "stream_route": SQL_STREAM_ROUTE,
    "stream_curate": LD.SQL_CURATED_RECORDS,
}
