"""Curation steps on landed responses.

The studied job crawls an HTTP API; here the responses are already landed
(one JSON text per request, with its status) and every step is a table
operation, so a crawl of any size is one distributed job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moleval.functions.scalars import only_tokens, to_number
from moleval.operators.filters import accept_tagged, exclude_above, require_present, until_first_failure
from moleval.sources.tables import parse_id_scan, parse_property_responses

# --- fixed values: drug-likeness limits of the curation step ---
LIPINSKI_LIMITS = {"HBondAcceptorCount": 10, "HBondDonorCount": 5, "ExactMass": 500}
DEFAULT_START_ID = 138962044
# --- end of fixed values ---


def max_id_scan(responses: DataFrame, start: int = DEFAULT_START_ID) -> DataFrame:
    """A11 (+F8): largest id found before the first failed/empty chunk,
    floored at ``start``, and the number of records checked.

    ``responses``: ``(chunk, status, body)``; a chunk without the compound
    list or with a non-200 status stops the scan.
    """
    parsed = parse_id_scan(responses)
    ok = (F.col("status") == 200) & F.col("has_compounds")
    kept = until_first_failure(parsed, "chunk", ok=ok)
    ids = kept.select(F.explode("cids").alias("cid"))
    return ids.agg(F.greatest(F.lit(start).cast("bigint"), F.coalesce(F.max("cid"), F.lit(start))).alias("max_id"),
                   F.count(F.lit(1)).alias("n_checked"))


def curate(responses: DataFrame, allowed=("C", "N", "O"), tagger=None, limits: dict | None = None) -> DataFrame:
    """Curation plan: parse landed property responses (S5) -> keep records
    with a SMILES (F5) -> element alphabet check (P17) -> optional group
    tagging with conflicts rejected (``tagger``: DataFrame -> DataFrame
    with a ``groups`` column, F6) -> range exclusions keeping missing values
    (F4).  No row cap: all records that pass are kept.
    """
    recs = parse_property_responses(responses)
    recs = require_present(recs, "CanonicalSMILES")
    recs = recs.where(only_tokens("CanonicalSMILES", allowed))
    if tagger is not None:
        recs = accept_tagged(tagger(recs))
    recs = recs.withColumn("ExactMass", to_number("ExactMass"))
    return exclude_above(recs, limits or LIPINSKI_LIMITS)
