"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder and hands them,
read again, to the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm import mixing, ngram_join, outliers, packing, toxicity
from eventide.llm.common import read_table, released, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return outliers.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score as toxic by a model fitted on the labelled ones among them."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id."""
    return ngram_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix uses them, a row per use, in training order."""
    return mixing.in_training_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the training sequence of each."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: The stages hold a trained classifier, an iterated estimate and a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        released(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
