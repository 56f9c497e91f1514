"""ST2: route accepted / rejected examples to two append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moleval.operators.ordered import ACCEPTED, REJECTED


def route_examples(stream: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str,
                   outcome: str = "outcome", fmt: str = "parquet", available_now: bool = True):
    """Start a query that appends accepted rows to one log and rejected rows
    to the other; near-duplicates go to neither.

    Each micro-batch is written under ``batch_id=<n>`` with overwrite of
    that folder only, so a batch replayed after a failure replaces its own
    earlier partial output (idempotent by batch id).
    """
    def write(batch: DataFrame, batch_id: int):
        batch.persist()
        for path, label in ((accepted_path, ACCEPTED), (rejected_path, REJECTED)):
            (batch.where(F.col(outcome) == label).drop(outcome)
                  .write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch_id={batch_id}"))
        batch.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
