"""Distributions of numeric features in two corpora, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 24


def _long(df: DataFrame, features: list[str], side: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("p")
    return df.select(pairs).select("p.*", F.lit(side).alias("side")).where("v is not null")


def moments(real: DataFrame, made: DataFrame, features: list[str]) -> DataFrame:
    """Means and deviations of both sides, the standardised and the relative difference, and how the features differ."""
    both = _long(real, features, "real").unionByName(_long(made, features, "made"))
    side = lambda s, v: F.when(F.col("side") == s, v)
    stats = both.groupBy("feature").agg(
        *[F.avg(side(s, F.col("v"))).alias(f"{s}_mean") for s in ("real", "made")],
        *[F.coalesce(F.stddev_samp(side(s, F.col("v"))), F.lit(0.0)).alias(f"{s}_std") for s in ("real", "made")],
        *[F.count(side(s, F.col("v"))).alias(f"{s}_n") for s in ("real", "made")],
    )
    empty = F.raise_error(F.lit("a side of the comparison is empty")).cast("double")
    diff = F.col("made_mean") - F.col("real_mean")
    pooled = F.sqrt((F.col("real_std") ** 2 + F.col("made_std") ** 2) / 2)
    d = F.when((F.col("real_n") == 0) | (F.col("made_n") == 0), empty).when(pooled > 1e-9, diff / pooled).when(F.abs(diff) > 1e-9, F.signum(diff) * 10).otherwise(0.0)
    relative = F.when(F.col("real_mean") != 0, diff / F.abs(F.col("real_mean"))).otherwise(0.0)
    return stats.withColumn("cohens_d", d).withColumn("relative", relative).withColumn("verdict", F.when(F.abs(d) < 0.2, "matched").when(F.abs(d) < 0.5, "close").otherwise("mismatched"))


def overlap(real: DataFrame, made: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """Shared histograms over the common range: the sum of the lesser shares; 1 if the range is a point."""
    both = _long(real, features, "real").unionByName(_long(made, features, "made"))
    limits = both.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("side") == "real").alias("n_real"), F.count_if(F.col("side") == "made").alias("n_made"))
    bin_of = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    placed = both.join(F.broadcast(limits), "feature").withColumn("bin", F.when(F.col("hi") - F.col("lo") < 1e-12, 0).otherwise(bin_of))
    share = lambda s: F.count_if(F.col("side") == s) / F.first(f"n_{s}")
    return placed.groupBy("feature", "bin").agg(F.least(share("real"), share("made")).alias("p")).groupBy("feature").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("overlap"))


def compare(real: DataFrame, made: DataFrame, features: list[str]) -> DataFrame:
    """The report, the largest standardised differences first."""
    return moments(real, made, features).join(overlap(real, made, features), "feature").orderBy(F.desc(F.abs("cohens_d")), "feature")
