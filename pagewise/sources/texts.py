"""Text sources: CSV, Parquet, JSON lines, mappings and inline sentences, as ``content`` and ``title``."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TextPolicy, normalize


def _usable(df: DataFrame, text: str, title: str | None) -> DataFrame:
    if text not in df.columns:
        raise ValueError(f"no column {text!r}; there are {', '.join(df.columns)}")
    has_title = title is not None and title in df.columns
    name = F.coalesce(F.col(f"`{title}`").cast("string"), F.lit("")) if has_title else F.lit(None).cast("string")
    return df.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").cast("string").alias("content"), name.alias("title"))


def read_csv(spark: SparkSession, path: str, text: str = "text", title: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Rows with a text; missing titles are empty where the title column is there."""
    return _usable(spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path), text, title)


def read_parquet(spark: SparkSession, path: str, text: str = "text", title: str | None = None) -> DataFrame:
    return _usable(spark.read.parquet(path), text, title)


def read_mappings(spark: SparkSession, rows: Iterable, text: str = "text", title: str | None = None) -> DataFrame:
    """Usable rows of an iterable: rows that are no mappings and null texts are skipped, empty texts are kept."""
    found = [(str(r[text]), None if title is None or r.get(title) is None else str(r[title])) for r in rows if isinstance(r, Mapping) and r.get(text) is not None]
    return spark.createDataFrame(found, "content string, title string")


def inline(spark: SparkSession, sentences: list[str]) -> DataFrame:
    if not sentences:
        raise ValueError("an inline source needs sentences")
    return spark.createDataFrame([(s, None) for s in sentences], "content string, title string")


def open_source(spark: SparkSession, kind: str, path: str | None = None, **options) -> DataFrame:
    """Reads a source by the name of its kind."""
    if kind == "inline":
        return inline(spark, options["sentences"])
    readers = {"csv": read_csv, "parquet": read_parquet}
    if kind not in readers:
        raise ValueError(f"unknown source {kind!r}; one of csv, inline, parquet")
    if not path:
        raise ValueError(f"a {kind} source needs a path")
    return readers[kind](spark, path, **options)


def provider(spark: SparkSession, kind: str, path: str | None, fallback: list[str], policy: TextPolicy = TextPolicy(), limit: int | None = None, **options) -> DataFrame:
    """Normalised contents of a source, or the fallback as it is where the source cannot be read or is empty."""
    if kind == "inline":
        return inline(spark, fallback).select("content")
    try:
        df = open_source(spark, kind, path, **options).select("content")
        df = df if limit is None else df.limit(limit)
        empty = df.isEmpty()
    except (PySparkException, OSError):  # the source is out of reach
        empty = True
    return inline(spark, fallback).select("content") if empty else df.select(normalize(F.col("content"), policy).alias("content"))


RECORD = "id string, page string, image_path string, provenance string, text string, markdown string, html string"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Page records of ``annotations-*.jsonl`` with the file and place they come from; blank lines are skipped."""
    lines = spark.read.option("pathGlobFilter", "annotations-*.jsonl").text(folder).where(F.trim("value") != "")
    return lines.select(F.from_json("value", RECORD).alias("r"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place")).select("r.*", "file", "place")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``prediction`` from JSON lines of id and prediction or text, or from one JSON map."""
    if path.endswith(".jsonl"):
        return spark.read.schema("id string, prediction string, text string").json(path).select("id", F.coalesce("prediction", "text", F.lit("")).alias("prediction"))
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "prediction"))


def apply_overrides(config: dict, overrides: list[str]) -> dict:
    """A copy of a configuration with dotted ``key=value`` overrides; values are JSON, or strings where they are not."""
    out = copy.deepcopy(config)
    for item in overrides:
        key, equals, value = item.partition("=")
        if not equals or not key:
            raise ValueError(f"an override looks like key=value, not {item!r}")
        at = out
        *parents, leaf = key.split(".")
        for name in parents:
            if not isinstance(at.get(name), dict):
                at[name] = {}
            at = at[name]
        try:
            at[leaf] = json.loads(value)
        except json.JSONDecodeError:
            at[leaf] = value
    return out
