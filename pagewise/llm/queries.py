"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, leaks, lengths, licences, lines, nearcopies, private, topk, toxicity, warc
from .shared import cut, scratch, table


def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is a near copy, with the document of its group that stays."""
    return nearcopies.groups(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, truncated totals and quantiles of encoded lengths for the context limit of every length."""
    return lengths.context_report(cut(lengths.histogram(table(spark, sf_dir, "documents"))))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that is taken for a licence notice."""
    documents = table(spark, sf_dir, "documents")
    return licences.scan(documents, licences.train(documents))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of every document, and the text that decoding them gives back."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, verdict and offending offsets of every document."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of personal data."""
    documents = table(spark, sf_dir, "documents")
    return private.scan(documents, private.train(documents))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return leaks.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay."""
    return lines.dedup(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written into compressed archives with a dictionary and read back."""
    pages, folder = table(spark, sf_dir, "pages"), scratch(spark, "warc")
    warc.write_archives(pages, folder, warc.train_dictionary(pages)).collect()
    return warc.pages(warc.read_archives(spark, folder))


WARC_SQL = "SELECT page_id, url, html, CAST(strlen(html) AS BIGINT) AS content_length, true AS valid FROM pages"


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products with all other vectors, for every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), queries="id % 50 = 0").withColumn("score", F.round("score", 6))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, list_inner_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id) AS k FROM p)
SELECT vec_id, CAST(k AS INTEGER) AS rank, neighbour_id, round(s, 6) AS score FROM r WHERE k <= 10
"""

LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), n AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM l WHERE trim(line) <> ''
), d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k > 1) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k = 1) AS kept FROM n GROUP BY doc_id
)
SELECT t.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN t.text ELSE coalesce(kept, '') END AS text,
       CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM documents t LEFT JOIN d ON t.doc_id = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_copies, op2_token_counts, op3_licence_scan, op4_byte_bpe, op5_toxicity, op6_private_data, op7_decontamination, op8_line_dedup, op9_warc, op10_exact_top_k)}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": LINE_SQL, "op9_warc": WARC_SQL, "op10_exact_top_k": TOP_K_SQL}
