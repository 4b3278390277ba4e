"""Scoring of documents as they arrive: the plan looks at one row at a time, so a stream is scored by the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from proseloom.functions.patterns import Options
from proseloom.operators import structure
from proseloom.plans.analyze import Analysis


def arriving(spark: SparkSession, source: str) -> DataFrame:
    """Documents (doc_id, text) in new Parquet files of source."""
    return spark.readStream.schema("doc_id long, text string").parquet(source)


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Scores of arriving documents, appended to target; ends when none is left. Documents don't depend on each other, so
    the result equals that of one batch over all files."""
    scores = Analysis(arriving(spark, source), options).scores()
    return scores.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cited_targets(docs: DataFrame) -> DataFrame:
    """target: the URLs that documents cite, repeats kept; docs may be a stream."""
    return structure.citations(structure.blocks(docs)).select("url").withColumnRenamed("url", "target")
