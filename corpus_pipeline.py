"""The corpus pipeline: documents pass five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewise.llm import bpe, leaks, lines, nearcopies, toxicity
from pagewise.llm.shared import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go; null and empty texts stay."""
    return toxicity.keep_clean(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each line its first occurrence stays; documents that lose every line go."""
    return lines.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return nearcopies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return leaks.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The symbols of every document that is left, and the text that decoding them gives back."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte-level bpe", encode),
]

#: The toxicity field is not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a data directory."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
