"""Deterministic draws: seeds, shards, weighted choices, fields and phrases from hashes of (seed, index, stream)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DIGITS, numerals, tokens, uniform

MONTHS = ("يناير", "فبراير", "مارس", "أبريل", "ماي", "يونيو", "يوليوز", "غشت", "شتنبر", "أكتوبر", "نونبر", "دجنبر")
CURRENCIES = ("MAD", "EUR", "USD", "GBP", "SAR")
PAPERS_MM = {"a3": (297, 420), "a4": (210, 297), "a5": (148, 210), "a6": (105, 148), "letter": (215.9, 279.4), "legal": (215.9, 355.6), "receipt": (80, 200), "id_card": (85.6, 54)}


def sample_seed(seed: int | None, index: Column) -> Column:
    """(seed * 1000003 + index * 2654435761) mod 2**32, a null seed as 0."""
    wide = lambda x: x.cast("decimal(38,0)")
    return F.pmod(wide(F.lit(seed or 0)) * F.lit(1000003) + wide(index) * wide(F.lit(2654435761)), wide(F.lit(1 << 32))).cast("bigint")


def plan_shards(spark: SparkSession, start: int, count: int, size: int) -> DataFrame:
    """``shard``, ``start``, ``stop``: contiguous ranges of indices."""
    n = -(-count // size)
    rows = spark.range(n).select(F.col("id").cast("int").alias("shard"), (F.col("id") * size + start).alias("start"))
    return rows.withColumn("stop", F.least(F.col("start") + size, F.lit(start + count)))


def effective_workers(workers: int, count: int, size: int) -> int:
    """More workers than shards are of no use."""
    return max(1, min(workers, -(-count // size)))


def pending(plan: DataFrame, finished: DataFrame) -> DataFrame:
    """Shards that are not among the finished ones."""
    return plan.join(finished.select("shard").distinct(), "shard", "left_anti")


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """The key whose cumulative weight first exceeds u of the total; keys without positive weight are never chosen."""
    usable = [(k, float(w)) for k, w in weights.items() if w > 0]
    if not usable:
        raise ValueError("no key has a positive weight")
    total, running, out = sum(w for _, w in usable), 0.0, None
    for key, w in usable:
        running += w
        out = F.when(u * total < running, key) if out is None else out.when(u * total < running, key)
    return out.otherwise(usable[-1][0])


def integer(u: Column, low: int, high: int) -> Column:
    """An integer from low to high, both included."""
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def date_field(seed: Column, index: Column, system: str = "western") -> Column:
    u = lambda s: uniform(seed, index, F.lit(f"date-{s}"))
    day, month, year = integer(u("d"), 1, 28), integer(u("m"), 1, 12), integer(u("y"), 1990, 2026)
    name = F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1)
    form = F.when(u("f") < 0.4, F.format_string("%02d/%02d/%d", day, month, year)).when(u("f") < 0.7, F.concat_ws(" ", day.cast("string"), name, year.cast("string"))).otherwise(F.format_string("%d-%02d-%02d", year, month, day))
    return numerals(form, system)


def amount_field(seed: Column, index: Column) -> Column:
    cents = F.floor(uniform(seed, index, F.lit("amount")) * 9999800 + 100)
    return F.concat_ws(" ", F.format_number(cents / 100, 2), F.get(F.array(*[F.lit(c) for c in CURRENCIES]), integer(uniform(seed, index, F.lit("currency")), 0, 4)))


def code_field(seed: Column, index: Column) -> Column:
    letters, seps = "ABCDEFGHJKLMNPQRSTUVWXYZ", "-/ ."
    u = lambda s: uniform(seed, index, F.lit(f"code-{s}"))
    pick = lambda s, text: F.substring(F.lit(text), F.floor(u(s) * len(text)).cast("int") + 1, F.lit(1))
    head = F.substring(F.concat(*[pick(f"l{i}", letters) for i in range(4)]), F.lit(1), integer(u("n"), 2, 4))
    tail = F.substring(F.concat(*[pick(f"g{i}", DIGITS["western"]) for i in range(9)]), F.lit(1), integer(u("m"), 4, 9))
    return F.concat(head, pick("s", seps), tail)


def phrase(text: Column, seed: Column, index: Column, most: int = 6) -> Column:
    """A run of 1 to ``most`` words of a text, without marks at its ends."""
    words = tokens(text)
    n = F.least(integer(uniform(seed, index, F.lit("phrase-n")), 1, most), F.size(words))
    start = F.floor(uniform(seed, index, F.lit("phrase-at")) * (F.size(words) - n + 1)).cast("int") + 1
    return F.when(F.size(words) > 0, F.regexp_replace(F.array_join(F.slice(words, start, n), " "), r"^[.،,;:]+|[.،,;:]+$", ""))


def title(text: Column, seed: Column, index: Column) -> Column:
    """The first 2 to 7 words, without a mark at the end."""
    words = F.slice(tokens(text), 1, integer(uniform(seed, index, F.lit("title")), 2, 7))
    return F.regexp_replace(F.array_join(words, " "), r"[.،,;:]+$", "")


def page_spec(paper: Column, dpi: Column, margin_mm: Column, columns: Column, gap: Column, landscape: Column) -> Column:
    """Pixels of a page and of its columns; an unknown paper is null."""
    w = F.lit(None).cast("int")
    h = w
    for name, (a, b) in PAPERS_MM.items():
        w, h = F.when(paper == name, a).otherwise(w), F.when(paper == name, b).otherwise(h)
    px = lambda mm: F.greatest(F.lit(1), F.round(mm / 25.4 * dpi).cast("int"))
    wide, high = F.when(landscape, px(h)).otherwise(px(w)), F.when(landscape, px(w)).otherwise(px(h))
    margin = px(margin_mm)
    column = F.floor((wide - 2 * margin - (columns - 1) * gap) / columns).cast("int")
    return F.struct(wide.alias("width"), high.alias("height"), margin.alias("margin"), column.alias("column_width"))


def ablation_arms(spark: SparkSession, arms: dict[str, dict[str, str]], seed: int, count: int) -> DataFrame:
    """``arm``, ``overrides``, ``index``, ``seed``: the same seeds for every arm."""
    rows = spark.createDataFrame([(k, v) for k, v in arms.items()], "arm string, overrides map<string,string>")
    return spark.range(count).select(F.col("id").alias("index"), sample_seed(seed, F.col("id")).alias("seed")).crossJoin(F.broadcast(rows))
