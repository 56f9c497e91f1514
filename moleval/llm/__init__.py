"""Training-data operators: filters, scoring, near-duplicate removal, mixing.

Nothing outside this folder (except ``corpus_pipeline.py`` and the guarded
import in ``__spark_entry__.py``) imports it.
"""
