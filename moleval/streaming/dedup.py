"""ST1: stateful recency de-dup on a stream (the stream form of W2).

Keys are dealt by hash into ``slots``; a slot's state, in a RocksDB store, is the last
``window`` accepted values of each of its keys, and with an event time the rows that
wait for the watermark, by time bucket.  So calls to the store grow with the slots and
the rows, not with the keys.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from moleval.operators.common import as_list
from moleval.operators.ordered import identity_text, recency_walk, rejected_flag

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET_MS = 3_600_000
SLOTS = 512                     # a checkpoint keeps the number it was begun with


class RecencyProcessor(StatefulProcessor):
    """Walks the rows of a slot's keys in order against each key's last accepted values.

    With ``bucket_ms``, rows wait in the store, a bucket of event time at a time, until the
    watermark has passed the bucket's end; a bucket's rows of one slot are all that is held in memory.
    Without, a micro-batch's rows of the slot are sorted and walked at once.
    """

    def __init__(self, names: list, window: int, order: list, cols: list, bucket_ms: int | None, idle_ms: int | None):
        self.names, self.window, self.order, self.cols, self.bucket_ms, self.idle_ms = names, window, order, cols, bucket_ms, idle_ms

    def _named(self, rows):
        """Spark hands computed columns over under other names, in the same order."""
        return (batch.set_axis(self.names, axis=1) for batch in rows if len(batch))

    def init(self, handle) -> None:
        self.handle = handle
        # JSON of {key: [accepted values, time to forget them]}; values as text: every digit of a whole number is kept, NULL is a value
        self.recent = handle.getValueState("recent", "data string")
        if self.bucket_ms:
            # JSON of {bucket: number of parts}
            self.parts = handle.getValueState("parts", "data string")
            self.rows = handle.getMapState("rows", "bucket bigint, part int", "data binary")

    def _walk(self, batch: pd.DataFrame, recent: dict, until: int | None) -> pd.DataFrame:
        batch = batch.sort_values(["_key", *self.order], kind="stable")
        key, value, bad = batch["_key"].to_numpy(), batch["_value"].tolist(), batch["_bad"].tolist()
        at = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        outcome = []
        for a, z in zip(at, at[1:]):
            state = deque(recent.get(key[a], ((), None))[0], maxlen=self.window)
            outcome += recency_walk(state, value[a:z], bad[a:z])
            recent[key[a]] = [list(state), until]
        out = batch[self.cols].copy()
        out["outcome"] = outcome
        return out

    def handleInputRows(self, key, rows, timerValues):
        if not self.bucket_ms:
            batches = list(self._named(rows))
            if batches:
                recent = _load(self.recent)
                out = self._walk(pd.concat(batches, ignore_index=True), recent, None)
                _save(self.recent, recent)
                yield out
            return
        parts = _load(self.parts)
        for batch in self._named(rows):
            for bucket, part in batch.groupby(batch["_ms"] // self.bucket_ms, sort=False):
                n = parts.get(str(int(bucket)), 0)
                self.rows.updateValue((int(bucket), n), (_packed(part),))
                parts[str(int(bucket))] = n + 1
                if n == 0:
                    self.handle.registerTimer((int(bucket) + 1) * self.bucket_ms)
        _save(self.parts, parts)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        parts, recent = _load(self.parts), _load(self.recent)
        due = sorted(b for b in map(int, parts) if (b + 1) * self.bucket_ms <= now)
        for bucket in due:
            n = parts.pop(str(bucket))
            batch = pd.concat([_unpacked(self.rows.getValue((bucket, i))[0]) for i in range(n)], ignore_index=True)
            for i in range(n):
                self.rows.removeKey((bucket, i))
            until = (bucket + 1) * self.bucket_ms + self.idle_ms if self.idle_ms else None
            if until:
                self.handle.registerTimer(until)
            yield self._walk(batch, recent, until)
        kept = {k: v for k, v in recent.items() if v[1] is None or v[1] > now}
        if due:
            _save(self.parts, parts)
        if due or len(kept) < len(recent):
            _save(self.recent, kept)

    def close(self) -> None:
        pass


def _load(state) -> dict:
    return json.loads(state.get()[0]) if state.exists() else {}


def _save(state, data: dict) -> None:
    if data:
        state.update((json.dumps(data),))
    else:
        state.clear()


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def recent_dedup_stream(stream: DataFrame, key, order, value: str, error: str | None = None,
                        window: int = 5, max_err: float = 20.0, keep=None, event_time: str | None = None,
                        delay: str = "0 seconds", bucket_ms: int = BUCKET_MS, idle_ms: int | None = None, slots: int = SLOTS) -> DataFrame:
    """Streaming DataFrame with an ``outcome`` column per input row
    ('accepted' / 'rejected' / 'duplicate').  ``value`` should already be
    rounded natively; values are compared as in the batch operator.

    ``event_time`` (a timestamp, the first of ``order``): a key's rows are walked in
    order of time whatever order files come in, as far as the watermark (``delay``
    behind the latest time seen) has come; rows that come later than that are
    dropped by Spark, rows ahead of it wait in the store.  ``idle_ms`` forgets a
    key's accepted values when it has had no row for so long.

    Without ``event_time``, a slot's rows of one micro-batch are sorted in memory and
    walked; across batches the order is that of arrival, so the result equals the
    batch operator when files come in order, and the source's limit per trigger
    (``maxFilesPerTrigger``) bounds what is sorted.

    ``slots`` is the number of groups that keys are dealt into: more of them for
    more rows at once (a task holds one slot's rows of a bucket or micro-batch).
    """
    stream.sparkSession.conf.set(PROVIDER_CONF, ROCKSDB)
    key, order = as_list(key), as_list(order)
    if event_time and isinstance(stream.schema[event_time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))     # a watermark asks for it
    keep = [c for c in (as_list(keep) or []) if c not in key]
    cols = key + keep
    identity = identity_text(stream, key)
    slot = F.pmod(F.xxhash64(identity), F.lit(slots)).cast("int").alias("_slot")
    extra = [slot, identity.alias("_key")] + [F.col(c) for c in order if c not in cols] + [identity_text(stream, [value]).alias("_value"), rejected_flag(stream, error, max_err).alias("_bad")]
    if event_time:
        extra.append((F.unix_micros(event_time) / 1000).cast("bigint").alias("_ms"))
        if event_time not in order + cols:
            extra.append(F.col(event_time))
        stream = stream.withWatermark(event_time, delay)
    src = stream.select(*cols, *extra)
    out_schema = T.StructType([src.schema[c] for c in cols] + [T.StructField("outcome", T.StringType(), False)])
    processor = RecencyProcessor(src.columns, window, order, cols, bucket_ms if event_time else None, idle_ms)
    return src.groupBy("_slot").transformWithStateInPandas(processor, out_schema, "append", "eventTime" if event_time else "none")
