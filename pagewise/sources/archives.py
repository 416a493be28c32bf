"""Tar shards of page records, and the log of shards that are complete."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "shard int, pages bigint"


def write_tar(pages: DataFrame, folder: str, extension: str = "png") -> DataFrame:
    """One ``shard-NNNNN.tar`` a shard with ``id.ext`` and ``id.json`` of each page, ordered by id; ``shard``, ``pages``.

    ``pages`` has shard, id, image (bytes) and record (JSON). A shard gets its name when it is complete, so a task that
    runs twice leaves one file. An empty shard has no file.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        shard, rows = int(key[0].as_py()), 0
        part, name = f"{path}/.{TaskContext.get().taskAttemptId()}-{shard}", f"{path}/shard-{shard:05d}.tar"
        table = pa.Table.from_batches(list(batches)).sort_by("id")
        with system.open_output_stream(part) as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for batch in table.to_batches(max_chunksize=64):
                for i, image, record in zip(*(batch.column(c).to_pylist() for c in ("id", "image", "record"))):
                    for ending, data in ((extension, image or b""), ("json", (record or "{}").encode())):
                        info = tarfile.TarInfo(f"{i}.{ending}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
                    rows += 1
        system.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([rows], pa.int64())], names=["shard", "pages"])

    return pages.select(F.col("shard").cast("int").alias("shard"), F.col("id").cast("string").alias("id"), F.col("image").cast("binary").alias("image"), F.col("record").cast("string").alias("record")).groupBy("shard").applyInArrow(run, LOG)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Shards that are complete; none where nothing was logged yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path)


def append_log(finished: DataFrame, path: str) -> None:
    finished.write.mode("append").parquet(path)


def run_summary(log: DataFrame) -> DataFrame:
    """Shards and pages of a run."""
    return log.agg(F.countDistinct("shard").alias("shards"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))
