"""A bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> DataFrame:
    """(text, label, h): at most ``max_rows`` documents with a label, smallest hash of the id first.

    The ids are chosen from the label table, so what is broadcast has at most
    ``max_rows`` rows and no text is shuffled but the sample's.  Null ids,
    labels and texts are left out.
    """
    ids = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
           .select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(doc_id).cast("string")).alias("h")))
    # hashes are even, so a share of their range holds the wanted rows (with room to spare) and few others are sorted
    share = (max_rows + 8 * max_rows ** 0.5 + 64) / max(ids.count(), 1)
    if share < 1:
        ids = ids.where(F.col("h") < int(-2 ** 63 + share * 2 ** 64))
    ids = ids.orderBy("h", "label", "i").limit(max_rows)
    return (docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).where("text IS NOT NULL")
            .join(F.broadcast(ids), "i").select("text", "label", "h").orderBy("h", "text", "label").limit(max_rows))
