"""Corpus pipeline: five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of ``docs``; ``run`` applies them in order to the documents table.  A runner may
write a stage's result as Parquet and read it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moleval.llm import crf_toxicity, edit_decontam, mix_systematic, recompress, simhash_trie
from moleval.llm.words import fields

TOXIC = 0.7                     # documents with a score from here on are rejected


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``; the field is fitted on the labelled ones among ``docs``."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = crf_toxicity.fit(docs, labels)
    score = crf_toxicity.toxicity(F.col("text"), spark, model)["score"]
    marked = docs.select(fields(docs.columns), score.alias("score"))
    return marked.where(F.col("score") < TOXIC).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near fingerprints."""
    return simhash_trie.dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that stand earlier in the corpus."""
    return recompress.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return edit_decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as its source's target takes it."""
    return mix_systematic.mix(docs)


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("substring dedup", cut_repeats),
          ("benchmark decontamination", drop_leaks), ("mixing", mix)]

# the fitted field and the fingerprints cannot be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
