"""Quality gate: predicates over pages, in order, and what they reject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annotations as an
from ..functions import geometry as g
from ..functions.text import has_tokens, strip_white


def verdict(name: str, passed: Column, value: Column) -> Column:
    return F.struct(F.lit(name).alias("validator"), passed.alias("passed"), value.cast("double").alias("value"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is named more than once: written out at each place it would be computed at each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def non_empty_text(text: Column, min_characters: int = 8, min_words: int = 2) -> Column:
    def judged(stripped: Column) -> Column:
        n = F.char_length(stripped)
        return verdict("NonEmptyText", (n >= min_characters) & has_tokens(stripped, min_words), n)

    return once(strip_white(F.coalesce(text, F.lit(""))), judged)


def boxes_inside(page: Column, tolerance: float = 1.0) -> Column:
    whole = g.pad(g.box(0, 0, page["width"], page["height"]), tolerance)
    outside = lambda b: ~g.contains(whole, b)
    regions = F.size(F.filter(page["regions"], lambda r: outside(r["bbox"])))
    words = F.size(F.filter(an.page_words(page), lambda w: outside(w["bbox"])))
    return once(regions + words, lambda n: verdict("BoxesInsidePage", n == 0, n))


def no_overlaps(page: Column, max_iou: float = 0.15) -> Column:
    """The largest overlap of two blocks: from the top down, each is held against those above that reach it."""
    blocks = F.filter(page["regions"], lambda r: (r["type"] != "separator") & (F.size(r["lines"]) > 0))
    down = F.array_sort(F.transform(blocks, lambda r: F.struct(*[r["bbox"][c].alias(c) for c in ("y0", "x0", "x1", "y1")])))
    none = F.array().cast("array<struct<y0:double,x0:double,x1:double,y1:double>>")

    def step(s: Column, b: Column) -> Column:
        reach = F.filter(s["open"], lambda a: a["y1"] > b["y0"])
        most = F.array_max(F.transform(s["open"], lambda a: g.iou(a, b)))
        return F.struct(F.concat(reach, F.array(b)).alias("open"), F.greatest(s["most"], F.coalesce(most, F.lit(0.0))).alias("most"))

    most = F.aggregate(down, F.struct(none.alias("open"), F.lit(0.0).alias("most")), step)["most"]
    return once(most, lambda m: verdict("NoOverlappingRegions", m <= max_iou, m))


def legible_lines(page: Column, min_height: float = 8.0, max_fraction: float = 0.1) -> Column:
    def share(lines: Column) -> Column:
        small = F.size(F.filter(lines, lambda x: g.height(x["bbox"]) < min_height))
        return F.when(F.size(lines) > 0, small / F.size(lines)).otherwise(0.0)

    return once(once(an.page_lines(page), share), lambda s: verdict("LegibleLineHeight", s <= max_fraction, s))


def annotation_checks(page: Column) -> list[Column]:
    """The checks that need no picture, in their order; those of ink and contrast are ``imaging.pixel_gate``."""
    return [non_empty_text(an.page_text(page)), boxes_inside(page), no_overlaps(page), legible_lines(page)]


#: All checks in the order in which a page is judged.
ORDER = ("NonEmptyText", "BoxesInsidePage", "MinInkCoverage", "MinContrast", "NoOverlappingRegions", "LegibleLineHeight")


def default_checks(page: Column, ink: Column, failing: Column, least_ink: float = 0.002, most_failing: float = 0.5) -> list[Column]:
    """All six checks of a page whose picture was judged (``ink``, ``failing`` of ``pixel_gate``)."""
    text, boxes, overlaps, lines = annotation_checks(page)
    return [text, boxes, verdict("MinInkCoverage", ink >= least_ink, ink), verdict("MinContrast", failing <= most_failing, failing), overlaps, lines]


def check(verdicts: list[Column], fail_fast: bool = True) -> Column:
    """``passed`` and ``failures``: the first failure only, or all of them in order."""
    failed = F.filter(F.array(*verdicts), lambda v: ~v["passed"])
    return once(failed, lambda f: F.struct((F.size(f) == 0).alias("passed"), (F.slice(f, 1, 1) if fail_fast else f).alias("failures")))


def split(pages: DataFrame, report: str = "report") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows."""
    return pages.where(F.col(report)["passed"]), pages.where(~F.col(report)["passed"])


def rejection_rates(pages: DataFrame, *by: str, report: str = "report") -> DataFrame:
    # the report is named once, so that it is not computed for each aggregate
    counted = pages.groupBy(*by).agg(F.count("*").alias("produced"), F.count_if(~F.col(report)["passed"]).alias("rejected"))
    return counted.withColumn("rate", F.col("rejected") / F.col("produced"))


def guarded(rates: DataFrame, most: float = 0.5) -> DataFrame:
    """The rates, as long as none exceeds the most that is allowed."""
    bad = F.raise_error(F.concat(F.lit("rejection rate too high: "), F.col("rate").cast("string"))).cast("double")
    return rates.withColumn("rate", F.when(F.col("rate") > most, bad).otherwise(F.col("rate")))


def failures_by_validator(pages: DataFrame, report: str = "report") -> DataFrame:
    # an outer explode: a filter on the failures would be pushed down with a second copy of the whole report
    return pages.select(F.explode_outer(F.col(report)["failures"]).alias("f")).where("f is not null").groupBy(F.col("f")["validator"].alias("validator")).agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "validator")


def missing_images(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose ``image_path`` is not among the files."""
    return records.join(files.select(F.col("path").alias("image_path")).distinct(), "image_path", "left_anti")


def missing_glyphs(texts: DataFrame, coverage: DataFrame) -> DataFrame:
    """``font``, ``id``, ``missing``, ``ratio``: characters of a text that a font (font, codepoint) lacks, white space and marks of direction aside."""
    ignored = [" ", "\t", "\n", "\r", *map(chr, range(0x200B, 0x2010)), "﻿"]
    chars = texts.select("id", F.posexplode(F.array_distinct(F.split("text", "", -1))).alias("pos", "char")).where((F.col("char") != "") & ~F.col("char").isin(*ignored))
    chars = chars.withColumn("codepoint", F.conv(F.hex(F.encode("char", "UTF-32")), 16, 10).cast("int"))
    fonts = coverage.select("font").distinct()
    alphabet = chars.select("codepoint").distinct()  # at most as many as there are code points, whatever the texts
    lacking = alphabet.crossJoin(fonts).join(coverage, ["font", "codepoint"], "left_anti").groupBy("codepoint").agg(F.collect_set("font").alias("fonts"))
    lost = chars.join(lacking, "codepoint").select("id", "pos", "char", F.explode("fonts").alias("font"))
    missing = lost.groupBy("font", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda s: s["char"]).alias("missing"))
    sizes = chars.groupBy("id").agg(F.count("*").alias("n")).crossJoin(fonts)
    found = sizes.join(missing, ["font", "id"], "left")
    none = F.coalesce("missing", F.array().cast("array<string>"))
    return found.select("font", "id", none.alias("missing"), (1 - F.size(none) / F.col("n")).alias("ratio"))
