"""Token counts: an exact histogram of encoded lengths, and what suffix sums over it answer.

Each document is cut into words as ``bpe`` cuts it, and the tokens of its words, counted once for each different word,
are its length; lengths are counted in a histogram that is combined before the only shuffle. Suffix sums of the
histogram answer, for every context limit L: documents and tokens in all, documents that are longer, tokens left when
each document is truncated to L, and quantiles. Between two lengths that occur these answers are linear in L, so a row
for each length that occurs holds them for every L.

Defined results: a null text has no length and is left out; an empty one has length 0; repeated rows count each;
ids and extra columns play no part; an empty table gives an empty result; texts and words may be of any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .bpe import VOCABULARY, load_ranks, split_words

#: Lengths of one block of the histogram, which is summed in one task.
BLOCK = 1 << 16
#: Words whose counts a task remembers; it starts again when there are more.
REMEMBERED = 1 << 20


class WordCounter:
    """Numbers of tokens of words; a word is one piece for the encoder, whatever is in it."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        ranks = load_ranks(path)
        self.encoder = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.ranks, self.known = ranks, {}

    def count(self, word: bytes) -> int:
        n = self.known.get(word)
        if n is None:
            n = 1 if word in self.ranks else len(self.encoder.encode_ordinary(word.decode()))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = n
        return n

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text of an array without nulls."""
        data, off = tb.text_bytes(texts)
        starts = split_words(data, off)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        _, at, place = tb.distinct(data, starts, ends)
        raw = data.tobytes()
        counts = np.fromiter((self.count(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist())), np.int64, len(at))
        total = np.concatenate([[0], np.cumsum(counts[place])])
        edge = np.searchsorted(starts, off)
        return total[edge[1:]] - total[edge[:-1]]


def token_lengths(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``length``, ``n``: numbers of documents by length, as counted in the tasks; lengths repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = WordCounter(path), Counter()
        for part in tb.chunks(batches, "text", 1 << 20):
            seen.update(counter.lengths(part.column("text")).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["length", "n"])

    texts = documents.select(F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "length bigint, n bigint")


def histogram(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``length``, ``n_docs`` for every length that occurs."""
    return token_lengths(documents, path).groupBy("length").agg(F.sum("n").alias("n_docs"))


def context_report(lengths: DataFrame) -> DataFrame:
    """The answers for the context limit of each length of a histogram.

    ``n_docs`` of that length, ``n_longer`` documents, ``total_tokens`` of all, ``truncated_tokens`` when documents
    are cut to the limit, ``quantile``: the share of documents that fit. Sums run over blocks of lengths first.
    """
    blocked = lengths.withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = blocked.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("length") * F.col("n_docs")).alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    offsets = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(before), zero).alias("d0"),
        F.coalesce(F.sum("t").over(before), zero).alias("t0"),
        F.sum("d").over(whole).alias("docs"),
        F.sum("t").over(whole).alias("tokens"),
    )
    w = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = blocked.join(offsets, "block").select(
        "length", "n_docs", "docs", "tokens", (F.col("d0") + F.sum("n_docs").over(w)).alias("fit"), (F.col("t0") + F.sum(F.col("length") * F.col("n_docs")).over(w)).alias("fit_tokens")
    )
    return fit.select(
        "length",
        "n_docs",
        (F.col("docs") - F.col("fit")).alias("n_longer"),
        F.col("tokens").alias("total_tokens"),
        (F.col("fit_tokens") + F.col("length") * (F.col("docs") - F.col("fit"))).alias("truncated_tokens"),
        (F.col("fit") / F.col("docs")).alias("quantile"),
    )


def truncated_tokens(report: DataFrame, limit: int) -> int:
    """Tokens left when documents are cut to any limit, from the answers for lengths that occur."""
    low = report.where(F.col("length") <= limit).orderBy(F.desc("length")).limit(1).first()
    if low is None:
        first = report.orderBy("length").limit(1).first()
        return 0 if first is None else limit * (first["n_docs"] + first["n_longer"])
    return low["truncated_tokens"] + (limit - low["length"]) * low["n_longer"]


def quantile_length(report: DataFrame, share: float) -> int | None:
    """The least length that at least this share of the documents fits into."""
    row = report.where(F.col("quantile") >= share).orderBy("length").limit(1).first()
    return None if row is None else row["length"]
