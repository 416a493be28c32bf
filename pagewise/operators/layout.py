"""Order of words and lines: greedy wrapping, direction runs, and streaks of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_white


def wrap(text: Column, width: int, advance: float = 1.0) -> Column:
    """Greedy first fit of words into lines of so many units; longer words are cut, and nothing is lost."""
    most = max(1, int(width / advance))
    # a line is as many characters as end where a word does, or those of a longer word; a break takes its space's place
    broken = F.regexp_replace(collapse_white(text), rf"(?s)([^ ].{{0,{most - 1}}})(?: |\z)|([^ ]{{{most}}})", "$1$2\n")
    return F.filter(F.split(broken, "\n", -1), lambda x: x != "")


def fit(lines: Column, height: float, line_height: float) -> Column:
    """The lines that fit, one at least, and how many do not."""
    n = max(1, int(height // line_height))
    return F.struct(F.slice(lines, 1, n).alias("lines"), F.greatest(F.size(lines) - n, F.lit(0)).alias("dropped"))


def visual_order(words: DataFrame, base: str = "base") -> DataFrame:
    """``place`` from 1 of each word (id, pos, direction or null, base): runs of one direction, runs and words reversed for rtl.

    A word without direction goes on with the run before it, or with the base direction at the start.
    """
    by = Window.partitionBy("id").orderBy("pos")
    known = F.coalesce(F.last("direction", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.col(base))
    found = words.withColumn("run_direction", known)
    change = (F.col("run_direction") != F.coalesce(F.lag("run_direction").over(by), F.col("run_direction"))).cast("int")
    found = found.withColumn("change", change).withColumn("run", F.sum("change").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("change")
    run_key = F.when(F.col(base) == "rtl", -F.col("run")).otherwise(F.col("run"))
    word_key = F.when(F.col("run_direction") == "rtl", -F.col("pos")).otherwise(F.col("pos"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(run_key, word_key)))


def visual_places(lines: DataFrame, base: str = "base") -> DataFrame:
    """``places`` of the words of each line (directions, an array of rtl, ltr or null, and base), as ``visual_order`` has them; no row leaves its task."""
    code = F.array_join(F.transform("directions", lambda x: F.when(x == "rtl", "r").when(x == "ltr", "l").otherwise("n")), "")
    found = lines.withColumn("_way", F.concat(F.when(F.col(base) == "rtl", "r").otherwise("l"), code))  # the base stands before the first word
    for way in "rl":  # words without direction go on with the run before them
        found = found.withColumn("_way", F.regexp_replace("_way", rf"(?:(?<={way})|(?!^)\G)n", way))
    found = found.withColumn("_way", F.split(F.substring(F.col("_way"), F.lit(2), F.size("directions")), "", -1)).withColumn("_n", F.size("directions"))
    starts = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: (i == 0) | (F.get("_way", i) != F.get("_way", i - 1)))
    found = found.withColumn("_starts", F.when(F.col("_n") > 0, starts).otherwise(F.array().cast("array<int>")))

    def places(start, k):
        end = F.coalesce(F.get("_starts", k + 1), F.col("_n"))
        turned, back = F.get("_way", start) == "r", F.col(base) == "rtl"
        first = F.when(back & turned, F.col("_n") - start).when(back, F.col("_n") - end + 1).when(turned, end).otherwise(start + 1)
        last = F.when(back & turned, F.col("_n") - end + 1).when(back, F.col("_n") - start).when(turned, start + 1).otherwise(end)
        return F.sequence(first, last)

    return found.withColumn("places", F.flatten(F.transform("_starts", places))).drop("_way", "_n", "_starts")


def failure_streaks(outcomes: DataFrame, *by: str) -> DataFrame:
    """The longest run of failures (``failed``, in the order of ``pos``) of each group."""
    w = Window.partitionBy(*by).orderBy("pos")
    islands = outcomes.withColumn("island", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*by, "island").agg(F.count_if("failed").alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("longest"))


def running_total(rows: DataFrame, value: str, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(value).over(w))
