"""Readers and writers: whole-text documents, the options file, the labelled manifest, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.functions.patterns import Options

CASE = "struct<file:string,band:string,rules:array<string>,knownGap:string,note:string,knownFalsePositives:array<string>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name), text; one row a file, without a byte-order mark."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.regexp_replace("value", "^﻿", "").alias("text"))


def read_options(spark: SparkSession, path: str | None) -> Options:
    """Defaults if no path is given; a missing file raises."""
    return Options() if path is None else Options.from_json(spark.read.text(path, wholetext=True).first()[0])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases with their position; a manifest without cases, or a case without file, raises. A missing band is
    Clean."""
    cases = spark.read.schema(f"cases array<{CASE}>").json(path, multiLine=True).select(F.posexplode("cases").alias("position", "c")).select("position", "c.*")
    bad = cases.agg(F.count("*"), F.count("file")).first()
    if not bad[0] or bad[1] < bad[0]:
        raise ValueError("a manifest needs cases, and each a file")
    none = F.array().cast("array<string>")
    return cases.select("position", "file", F.coalesce("band", F.lit("Clean")).alias("band"), F.coalesce("rules", none).alias("rules"), F.col("knownGap").alias("known_gap"), "note", F.col("knownFalsePositives").alias("known_false_positives"))


def missing_documents(cases: DataFrame, docs: DataFrame) -> DataFrame:
    return cases.join(docs, cases["file"] == docs["doc_id"], "left_anti").select("file")


def write_json_reports(reports: DataFrame, path: str) -> None:
    reports.select("json").write.text(path)
