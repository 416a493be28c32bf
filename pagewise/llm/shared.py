"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that all executors share.

    The session's ``spark.checkpoint.dir`` is used where it is set; otherwise, on one machine, a temporary folder is
    made and becomes the session's checkpoint folder. On a cluster the setting is required.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagewise-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """The file system and path of a URI; Hadoop's names for S3 are known too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder.

    The files survive the loss of executors and go when nothing refers to them any more.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(collect: bool = True) -> None:
    """Gives freed memory of this process back to the system."""
    import pyarrow as pa

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that the DataFrame does not have, in whatever case, made from some names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def sample_texts(df: DataFrame, column: str, n: int) -> list[str]:
    """At most about ``n`` texts of a column, those of least hash: copies of one text come together or not at all.

    Tasks send hashes to the driver first, and then only the texts up to the n-th hash; null and empty ones never.
    """
    hashed = df.select(F.col(column).cast("string").alias("t")).where("t is not null and t <> ''").withColumn("h", F.xxhash64("t"))
    least = hashed.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if least is None:
        return []
    return [r["t"] for r in hashed.where(F.col("h") <= least).dropDuplicates(["h"]).orderBy("h").collect()]
