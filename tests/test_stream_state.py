"""ST1 with event time: equal to batch over shuffled files, across restarts, with state that expires."""
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from moleval.operators import ordered as O
from moleval.streaming.dedup import recent_dedup_stream
from moleval.streaming.runner import run_available_now, scratch_path

SCHEMA = "user_id long, event_id long, ts timestamp, k long, err double"
DAY = 86_400_000


def land(spark, df, folder, files, seed=0, first=0):
    """Write the rows as ``files`` files in random order, with rising file times."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    now = time.time() - 1000
    for i in range(files):
        path = f"{folder}/part{first + i}"
        spark.createDataFrame(rows[i::files], SCHEMA).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(os.path.join(path, f), (now + first + i, now + first + i))


def close(spark, folder, ts="2100-01-01", first=900):
    """A row far ahead lets the watermark pass all others."""
    land(spark, spark.sql(f"SELECT -1L AS user_id, -1L AS event_id, timestamp'{ts}' AS ts, 0L AS k, 0D AS err"), folder, 1, first=first)


def stream(spark, folder, per_trigger=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)


def dedup(s, **kw):
    return recent_dedup_stream(s, "user_id", ["ts", "event_id"], "k", error="err", keep=["event_id"], event_time="ts", delay="3650 days", bucket_ms=kw.pop("bucket_ms", 30 * DAY), **kw)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id", "event_id", "ts", F.floor("value").cast("bigint").alias("k"), (F.col("value") - 50.0).alias("err")).cache()


def outcomes(df):
    return {(r["event_id"], r["outcome"]) for r in df.collect() if r["event_id"] >= 0}


def test_shuffled_files_equal_batch(spark, events):
    want = outcomes(O.recent_dedup(events, "user_id", ["ts", "event_id"], "k", error="err", keep=["event_id"]))
    folder = scratch_path(spark, "shuffled")
    land(spark, events, folder, 4, seed=1)
    close(spark, folder)
    sink = run_available_now(dedup(stream(spark, folder)), scratch_path(spark, "out"))
    assert outcomes(spark.read.parquet(sink)) == want


def test_restart_goes_on_from_the_store(spark, events):
    """A hot key's rows come in two runs of one checkpoint; half of them wait in the store in between."""
    hot = events.withColumn("user_id", F.lit(7).cast("bigint"))
    want = outcomes(O.recent_dedup(hot, "user_id", ["ts", "event_id"], "k", error="err", keep=["event_id"]))
    folder, sink, ckpt = (scratch_path(spark, n) for n in ("hot", "hot-out", "hot-ckpt"))
    rows = hot.orderBy(F.xxhash64("event_id")).collect()
    land(spark, spark.createDataFrame(rows[:500], SCHEMA), folder, 2, seed=2)
    run_available_now(dedup(stream(spark, folder), bucket_ms=DAY), sink, ckpt)
    land(spark, spark.createDataFrame(rows[500:], SCHEMA), folder, 2, seed=3, first=10)
    close(spark, folder)
    run_available_now(dedup(stream(spark, folder), bucket_ms=DAY), sink, ckpt)
    assert outcomes(spark.read.parquet(sink)) == want


def test_idle_keys_are_forgotten(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    rows = [(1, 1, at(1), 5, 0.0), (1, 2, at(2), 5, 0.0), (1, 3, at(20), 5, 0.0), (2, 4, at(1), 5, 0.0), (2, 5, at(20), 6, 0.0)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, k long, err double").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = scratch_path(spark, "idle")
    land(spark, df.where("event_id in (1, 2, 4)"), folder, 1)
    close(spark, folder, "2034-01-15", first=5)                 # ten years of delay: the watermark comes to mid-January 2024
    land(spark, df.where("event_id in (3, 5)"), folder, 1, first=10)
    close(spark, folder)
    got = {}
    for idle in (None, 5 * DAY):
        sink = run_available_now(dedup(stream(spark, folder), bucket_ms=DAY, idle_ms=idle), scratch_path(spark, "idle-out"))
        got[idle] = {e: o for e, o in outcomes(spark.read.parquet(sink))}
    assert got[None] == {1: "accepted", 2: "duplicate", 3: "duplicate", 4: "accepted", 5: "accepted"}
    assert got[5 * DAY] == {1: "accepted", 2: "duplicate", 3: "accepted", 4: "accepted", 5: "accepted"}


def test_store_grows_with_slots_and_not_with_keys(spark, events):
    """900 keys in 4 slots: the outcomes are those of the batch operator and the store is written per slot, not per key."""
    many = events.withColumn("user_id", F.when(F.col("event_id") % 50 != 0, F.col("event_id") % 900).cast("bigint"))     # NULL is a key
    want = outcomes(O.recent_dedup(many, "user_id", ["ts", "event_id"], "k", error="err", keep=["event_id"]))
    folder, sink = scratch_path(spark, "slots"), scratch_path(spark, "slots-out")
    land(spark, many, folder, 2, seed=4)
    close(spark, folder)
    q = (dedup(stream(spark, folder), bucket_ms=3650 * DAY, slots=4).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", scratch_path(spark, "slots-ckpt")).trigger(availableNow=True).start(sink))
    q.awaitTermination()
    assert outcomes(spark.read.parquet(sink)) == want
    assert sum(s.numRowsUpdated for p in q.recentProgress for s in p.stateOperators) < 200
