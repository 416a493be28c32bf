"""Corpus statistics and the gate over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import quality


def read_documents(spark: SparkSession, folder: str, schema, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def counts(documents: DataFrame, *by: str) -> DataFrame:
    """Running documents and characters of each group, for complete or update mode."""
    return documents.groupBy(*by).agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).alias("characters"))


def gate(documents: DataFrame, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Splits a stream into accepted and rejected rows; what is there is read once, and a restart goes on from the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        checked = batch.withColumn("report", quality.check([quality.non_empty_text(F.col("text"))])).persist()
        good, bad = quality.split(checked)
        good.drop("report").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        bad.select("*", F.col("report")["failures"][0]["validator"].alias("validator")).drop("report").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        checked.unpersist()

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
