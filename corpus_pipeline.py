"""The corpus pipeline: quality classifier, near-duplicate join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared folder and
rereads it as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proseloom.llm.common import staged, table
from proseloom.llm.nearjoin import one_of_each
from proseloom.llm.packing import pack_documents
from proseloom.llm.quality import reject
from proseloom.llm.repeats import cleaned


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.5 or more."""
    return reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that a document with a smaller id has too."""
    return cleaned(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens: one row per piece."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", packing)]
#: A trained model decides what the first stage keeps, so there is no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
