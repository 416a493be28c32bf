"""Statistics of a corpus of page records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def line_words(line: Column) -> Column:
    """Words of a line: its word boxes, or the tokens of its text where it has none."""
    return F.coalesce(F.nullif(F.size(line["words"]), F.lit(0)), F.size(tokens(line["text"])))


def text_totals(texts: DataFrame, text: str = "text") -> DataFrame:
    """Lines, words and characters of line texts; line breaks are no characters."""
    line = F.explode(F.split(text, "\n", -1)).alias("line")
    lines = texts.select(line).where("line <> ''")
    return lines.agg(F.count("*").alias("lines"), F.sum(F.size(tokens(F.col("line")))).alias("words"), F.sum(F.char_length("line")).alias("characters"))


def counters(df: DataFrame, *dimensions: str) -> DataFrame:
    """``dimension``, ``value``, ``n`` of several columns in one pass; null and empty values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("p")
    return df.select(pairs).select("p.*").where("value is not null and value <> ''").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def most_common(df: DataFrame, value: str, position: str, n: int | None = None) -> DataFrame:
    """Values by falling count; equal counts by first appearance."""
    found = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(position).alias("first")).orderBy(F.desc("n"), "first")
    return found if n is None else found.limit(n)


def shares(counts: DataFrame) -> DataFrame:
    """Counts and their shares of their dimension."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))


def alphabet(df: DataFrame, text: str = "text") -> DataFrame:
    """``char``, ``n`` of the characters of line texts; batches of texts are reduced to distinct characters with counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            texts = b.column(0).drop_null().cast(pa.large_string())
            raw = texts.buffers()[2] if len(texts) else None
            edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0, 0]
            if raw is not None:
                points = np.frombuffer(bytes(raw)[edge[0] : edge[-1]].decode().encode("utf-32-le"), np.uint32)
                total += np.bincount(points, minlength=len(total))
        total[10] = 0
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in found], pa.string()), pa.array(total[found])], names=["char", "n"])

    return df.select(F.col(text).cast("string")).mapInArrow(run, "char string, n bigint").groupBy("char").agg(F.sum("n").alias("n"))


def rarest(counts: DataFrame, n: int = 15) -> DataFrame:
    return counts.orderBy("n", "char").limit(n)


def nearest_rank(df: DataFrame, value: str, fractions: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """``fraction``, ``value``: the value at index min(n - 1, int(f n)), by counts of different values; no rows if empty."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("c"))
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = counts.agg(F.sum("c").alias("total"))
    ranked = counts.withColumn("upto", F.sum("c").over(w)).crossJoin(F.broadcast(total))
    asked = df.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")
    index = F.least(F.col("total") - 1, F.floor(F.col("fraction") * F.col("total")))
    return ranked.join(F.broadcast(asked), (F.col("upto") > index) & (F.col("upto") - F.col("c") <= index)).select("fraction", "value")


def words_by_type(regions: DataFrame) -> DataFrame:
    return regions.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def documents(records: DataFrame, index: str = "index") -> DataFrame:
    return records.agg(F.countDistinct(index).alias("documents"))
