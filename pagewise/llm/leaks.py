"""Benchmark decontamination by spaced seeds.

Fixed masks ignore some token positions of a window, so a window with substituted words at those positions keeps
its hash. Items that are shorter than these masks have masks of their own length, each of which ignores one inner
position, or none where ``share`` of the item allows no substitution: items of fewer than five tokens must be found
word for word, and whoever does not want items of a word or two searched for leaves them out. Hashes of the benchmark's windows, sent to the tasks in parts of at most ``PART_TOKENS`` tokens, are looked
up for every window of every document in one pass over the scan; a larger benchmark takes more passes. Around each
hit the document and the item are laid against each other on that diagonal, and the best segment (a match counts 1,
a substitution -2) is an overlap if it matches ``least`` tokens, or ``share`` of an item that is shorter than that.

Tokens are those of ``textbatch``. Defined results: null and empty texts and items without tokens overlap with nothing; items of the same id are separate texts, of which the best overlap counts; each row with an
overlap gives one row an item, repeated rows too (ties go to the first place in the document); a null doc_id stays
null; extra columns play no part; empty tables give empty results. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

MASKS = ("11101100111", "11010111011", "110110100111")
LEAST, SHARE = 12, 0.8
PART_TOKENS, AT_ONCE = 2_000_000, 1_000_000
SCHEMA = "doc_id bigint, item_id bigint, start int, end int, matched int, aligned int"
_FIELDS = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.int32()), ("aligned", pa.int32())]


def window_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the window that begins at each token."""
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out += h[j : j + n] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return tb.mix(out)


def short_masks(n: int, share: float = SHARE) -> list[str]:
    """The masks of items of ``n`` tokens, fewer than the fixed masks have."""
    whole = "1" * n
    if n - 1 < share * n or n < 3:
        return [whole]
    return [whole[:k] + "0" + whole[k + 1 :] for k in range(1, n - 1)]


def _places(w: tb.Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens at which a window lies in one row, and its hashes."""
    h = window_hashes(w.hashes, mask)
    row = w.rows[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + len(mask) <= w.offsets[1:][row])
    return at, h[at]


@dataclass
class Seeds:
    """Windows of some benchmark items: for each mask the hashes, ascending, and the tokens where they begin."""

    items: list[int]
    hashes: np.ndarray
    offsets: np.ndarray
    masks: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def seeds(items: list[tuple[int, str]], share: float = SHARE) -> Seeds:
    w = tb.words(pa.array([t for _, t in items], pa.large_string()))
    length = np.diff(w.offsets)
    masks = {}
    most = max(map(len, MASKS))
    for mask in (*MASKS, *(m for n in sorted({int(n) for n in length if 0 < n < most}) for m in short_masks(n, share))):
        at, h = _places(w, mask)
        if mask not in MASKS:
            own = length[w.rows[at]] == len(mask)
            at, h = at[own], h[own]
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << 22, bool)
        bits[(h >> np.uint64(42)).astype(np.int64)] = True
        masks[mask] = (h[order], at[order], bits)
    return Seeds([i for i, _ in items], w.hashes, w.offsets, masks)


def segments(same: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place, and matches, of the best segment of each diagonal; diagonals lie one after the other from ``edge``.

    Each has at least one match. All are summed at once: each begins lower than any before it can be.
    """
    n = np.diff(edge)
    which = np.repeat(np.arange(len(n)), n)
    total = np.cumsum(np.where(same, 1, -2))
    before = np.concatenate([[0], total[:-1]])
    drop = which * (3 * len(same) + 1)
    low = np.minimum.accumulate(before - drop) + drop
    gain = total - low
    end = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, edge[:-1]), n))
    end = end[np.unique(which[end], return_index=True)[1]]
    begin = np.flatnonzero((before == low[end][which]) & same & (np.arange(len(same)) <= end[which]))
    begin = begin[np.unique(which[begin], return_index=True)[1]]
    matches = np.concatenate([[0], np.cumsum(same)])
    return begin - edge[:-1], end + 1 - edge[:-1], matches[end + 1] - matches[begin]


def find(w: tb.Words, s: Seeds, least: int = LEAST, share: float = SHARE) -> list[tuple[int, int, int, int, int, int]]:
    """Verified overlaps: row, item, first and last token, matches, tokens laid against each other; the best of each row and item."""
    lines = []
    for mask, (known, begin, bits) in s.masks.items():
        at, h = _places(w, mask)
        maybe = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)])
        at, h = at[maybe], h[maybe]
        left, right = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        n = right - left
        if n.sum():
            doc = np.repeat(at, n)
            item = begin[np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            lines.append(np.stack([doc, item], 1))
    if not lines:
        return []
    hits = np.concatenate(lines)
    rows = np.searchsorted(w.offsets, hits[:, 0], "right") - 1
    owner = np.searchsorted(s.offsets, hits[:, 1], "right") - 1
    diagonal = np.unique(np.stack([rows, owner, hits[:, 0] - hits[:, 1]], 1), axis=0)
    best: dict[tuple[int, int], tuple] = {}
    row, k, d = diagonal.T
    lo, hi = np.maximum(s.offsets[k], w.offsets[row] - d), np.minimum(s.offsets[k + 1], w.offsets[row + 1] - d)
    of, to = 0, 0
    while of < len(row):
        to = max(of + 1, int(np.searchsorted(np.cumsum((hi - lo)[of:]), AT_ONCE, "right")) + of)
        a, size = lo[of:to], (hi - lo)[of:to]
        edge = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(a - edge[:-1], size) + np.arange(edge[-1])
        same = s.hashes[place] == w.hashes[place + np.repeat(d[of:to], size)]
        begin, end, matched = segments(same, edge)
        ok = np.flatnonzero(matched >= np.minimum(least, share * (s.offsets[k[of:to] + 1] - s.offsets[k[of:to]])))
        base = a[ok] + d[of:to][ok]
        for r, i, *found in zip(row[of:to][ok].tolist(), k[of:to][ok].tolist(), (-matched[ok]).tolist(), (base + begin[ok]).tolist(), (base + end[ok]).tolist(), (end - begin)[ok].tolist()):
            key = (r, s.items[i])
            best[key] = min(best.get(key, tuple(found)), tuple(found))
        of = to
    return [(row, item, b, e, -m, n) for (row, item), (m, b, e, n) in sorted(best.items())]


def _parts(benchmark: DataFrame, tokens: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct items in parts of about so many tokens; a part is what the driver holds at once."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * tokens)))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        found = sorted((r["item_id"], r["text"]) for r in part.collect())
        if found:
            yield found


def overlaps(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``doc_id``, ``item_id``, offsets of the overlap in the text, tokens that match, tokens laid against each other."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _parts(benchmark, part_tokens):
        shared = spark.sparkContext.broadcast(seeds(items, share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in tb.chunks(batches, "text"):
                w = tb.words(part.column("text"))
                found = find(w, shared.value, least, share)
                if found:
                    ids = part.column("doc_id").to_pylist()
                    chars = tb.code_points_before(w.data)
                    made = [(ids[r], i, int(chars[w.starts[b]] - chars[w.row_bytes[r]]), int(chars[w.ends[e - 1]] - chars[w.row_bytes[r]]), m, n) for r, i, b, e, m, n in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*made), _FIELDS)], names=[f for f, _ in _FIELDS])

        one = rows.mapInArrow(run, SCHEMA)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    return out


def keep_clean(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE, part_tokens: int = PART_TOKENS) -> DataFrame:
    """The rows without an overlap, with all their columns."""
    for items in _parts(benchmark, part_tokens):
        shared = documents.sparkSession.sparkContext.broadcast(seeds(items, share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in tb.chunks(batches, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, *_ in find(tb.words(part.column("text")), shared.value, least, share)]] = False
                if keep.any():
                    yield part.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
