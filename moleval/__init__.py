"""moleval: dataset curation, prompt preparation and model evaluation on Spark.

Sub-packages
------------
sources    readers (CSV, JSON, landed API responses) and sinks
functions  Column-level helpers (number extraction, letter counts, prompt text,
           Student-t p-values, ...) built only from ``pyspark.sql.functions``
operators  DataFrame -> DataFrame operators (filters, joins, metrics, tests,
           ordered folds, rule tagging, splits, ranking, user predictors)
plans      end-to-end jobs composed from the operators, and the bindings
           to the driver test tables
streaming  Structured Streaming versions of the curation and de-dup steps
"""

from moleval.session import get_session, checkpoint_dir, cut_lineage

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
