"""Near copies: weighted-Jaccard signatures by BagMinHash, banding, and exact verification of multiset overlaps.

A document is the multiset of its word triples (fewer than three words: the one tuple of all). Weights are counts,
discretised at the integers; the heights [0,1), [1,2), [2,4), [4,8) ... of a triple each carry their own Poisson
process over time, whose points have an integer height, a register and an identity, all drawn from hashes of the
triple. A triple of weight w takes the points below height w, so a register's first point is the same for two
documents with a probability that is their weighted Jaccard similarity. Processes are followed up to the time at
which all registers are expected to be filled, and further where one is empty.

Triples are known by 64-bit hashes of their words. Banded signatures link the documents of a bucket to its least id, so
that a bucket lies in one candidate component; a bucket of any size is counted before it is shuffled, and no task has
to hold one. Linked documents are compared first, by the exact multiset Jaccard similarity of their
triples; then every other pair of the component that can reach ``threshold`` and is not yet in one group. Which
can is decided exactly, by their sizes and the rarest triples of each, so a passage that many documents share makes
no pairs by itself. Groups are the connected components of the pairs that reach ``threshold``; the least id of
a group is the document that stays. Documents with equal multisets are grouped by a 128-bit sum of hashes first,
so groups of exact copies of any size cost one row each.

Defined results: null ids, null texts and texts without words are in no group; rows that share an id are one
document, which is near whatever one of its texts is near; ties go to the least id; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .graph import components
from .shared import cut, free_names, scratch

REGISTERS, ROWS, THRESHOLD = 128, 4, 0.5
#: Candidate components of more triples than this, which a task would have to hold at once, are verified in a join.
LOCAL_TRIPLES = 4_000_000
#: Up to so many texts of a component are compared without looking for shared triples; so many pairs are made at once.
_FEW, _PAIRS = 16, 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def elements(w: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, triple and count of the multisets of some rows, ordered by row and triple."""
    rows, n = w.rows, len(w.starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    left = w.offsets[1:][rows] - np.arange(n)
    second, third = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    second[:-1], third[:-2] = w.hashes[1:], w.hashes[2:]
    second[left < 2], third[left < 3] = 0, 0
    triple = tb.mix(w.hashes * np.uint64(0xC2B2AE3D27D4EB4F) + second * np.uint64(0x165667B19E3779F9) + third * np.uint64(0xD6E8FEB86659FD93))
    at = np.flatnonzero((left >= 3) | (w.offsets[:-1][rows] == np.arange(n)))
    row, triple = rows[at], triple[at]
    order = np.argsort(triple)
    order = order[np.argsort(row[order].astype(np.uint16 if len(w.offsets) <= 1 << 16 else np.uint32), kind="stable")]
    row, triple = row[order], triple[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (triple[1:] != triple[:-1])]))
    return row[first], triple[first], np.diff(np.append(first, len(row)))


def signatures(row: np.ndarray, triple: np.ndarray, count: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The signatures of ``n`` multisets: time and identity of the first point of each register; full ones where empty."""
    sig = np.full(n * registers, _FULL)
    weight = np.bincount(row, weights=count, minlength=n)
    limit = (np.log(registers) + 4) * registers / np.maximum(weight, 1)
    todo = np.ones(len(row), bool)
    while todo.any():
        r0, f0, c0 = row[todo], triple[todo], count[todo]
        low = 0
        while True:
            at = np.flatnonzero(c0 > low)
            if not len(at):
                break
            _follow(sig, r0[at], tb.mix(f0[at] + np.uint64((low + 1) * int(_STEP) & int(_FULL))), c0[at], low, limit, registers)
            low = max(1, 2 * low)
        holes = (sig.reshape(n, registers) == _FULL).any(1) & (weight > 0)
        limit[holes] *= 2
        todo = holes[row]
    return sig.reshape(n, registers)


def _follow(sig: np.ndarray, row: np.ndarray, seed: np.ndarray, count: np.ndarray, low: int, limit: np.ndarray, registers: int) -> None:
    """Follows the processes of heights from ``low`` on, whose rates are the numbers of their heights."""
    rate = max(1, low)
    time, k = np.zeros(len(row)), 0
    while len(row):
        wide = int(np.clip(100_000 // len(row), 1, 64))
        u = tb.mix(seed[:, None] + np.arange(k + 1, k + wide + 1, dtype=np.uint64)[None, :] * _STEP)
        k += wide
        at = time[:, None] + np.cumsum(-np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate, axis=1)
        point = tb.mix(u ^ np.uint64(0x5851F42D4C957F2D))
        ok = at <= limit[row][:, None]
        if rate > 1:
            ok &= low + ((point >> np.uint64(8)) % np.uint64(rate)).astype(np.int64) < count[:, None]
        i, j = np.nonzero(ok)
        place = row[i] * registers + (point[i, j] % np.uint64(registers)).astype(np.int64)
        np.minimum.at(sig, place, (at[i, j].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (point[i, j] >> np.uint64(32)))
        time = at[:, -1]
        on = time <= limit[row]
        row, seed, count, time = row[on], seed[on], count[on], time[on]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard similarity of two multisets given as ascending triples and counts."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def sketch(documents: DataFrame, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, the halves of the key of its multiset, the size of this, a hash a band; no row for texts without words."""
    bands = registers // rows
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("triples", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.chunks(batches, "text", 1 << 20):
            row, triple, count = elements(tb.words(part.column("text")))
            if not len(row):
                continue
            some, row = np.unique(row, return_inverse=True)
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            k1 = np.add.reduceat(tb.mix(triple + np.uint64(1)) * count.astype(np.uint64), begin)
            k2 = np.add.reduceat(tb.mix(triple ^ np.uint64(0xA0761D6478BD642F)) * count.astype(np.uint64), begin)
            sig = signatures(row, triple, count, len(some), registers).reshape(len(some), bands, rows)
            h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _STEP
            for r in range(rows):
                h = tb.mix(h * np.uint64(31) + sig[:, :, r])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(h.ravel().view(np.int64)))
            size = pa.array(np.add.reduceat(count, begin).astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), size, lists], schema=schema)

    usable = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return usable.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, triples bigint, bands array<bigint>")


def candidates(sketches: DataFrame) -> DataFrame:
    """Pairs a < b of the documents of each bucket and its least id; least ids are found before a bucket is shuffled."""
    spread = sketches.select("doc_id", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("most")).where("a < most").select("band", "a")
    return spread.join(shared, "band").where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()


def _multisets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    row, triple, count = elements(tb.words(texts))
    edge = np.searchsorted(row, np.arange(len(texts) + 1))
    return [(triple[a:b], count[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def _expand(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of some multisets, and their elements one after the other: the k-th copy of a triple is an element of its own."""
    size = np.array([c.sum() for _, c in sets], np.int64)
    count = np.concatenate([c for _, c in sets]).astype(np.int64)
    copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return size, tb.mix(np.repeat(np.concatenate([x for x, _ in sets]), count) + copy.astype(np.uint64) * _STEP)


def _able(sets: list[tuple[np.ndarray, np.ndarray]], roots: Callable[[], np.ndarray], threshold: float) -> Iterator[tuple[int, int]]:
    """The pairs of different roots that can reach the threshold t, each once; roots are asked for again as pairs are made.

    Where x is the smaller of two texts that reach it, they share an element that is among the rarest
    n - 2tn / (1 + t) + 1 of the n of x and the rarest n - tn + 1 of the n of y, rarest in one order for all.
    """
    n, (size, element) = len(sets), _expand(sets)
    if n <= _FEW:
        group = roots()
        yield from ((i, j) for j in range(n) for i in range(j) if group[i] != group[j] and min(size[i], size[j]) >= threshold * max(size[i], size[j]) - 1e-6)
        return
    row = np.repeat(np.arange(n), size)
    _, token, many = np.unique(element, return_inverse=True, return_counts=True)
    order = np.lexsort((token, many[token], row))
    token = token[order]
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    group, low, high = roots(), np.full(len(many), np.iinfo(np.int64).max), np.full(len(many), np.iinfo(np.int64).min)
    np.minimum.at(low, token, group[row])
    np.maximum.at(high, token, group[row])
    differ = (low < high)[token]
    known = np.flatnonzero(differ & (place <= (size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-6))[row]))
    known = known[np.argsort(token[known], kind="stable")]
    asked = np.flatnonzero(differ & (place <= (size - np.ceil(threshold * size - 1e-6))[row]))
    left, right = np.searchsorted(token[known], token[asked], "left"), np.searchsorted(token[known], token[asked], "right")
    end = np.cumsum(right - left)
    k, before = 0, np.empty(0, np.int64)
    while k < len(asked):
        to = max(k + 1, int(np.searchsorted(end, (end[k - 1] if k else 0) + _PAIRS, "right")))
        length = (right - left)[k:to]
        x = row[known[np.repeat(left[k:to] - np.cumsum(length) + length, length) + np.arange(length.sum())]]
        y = np.repeat(row[asked[k:to]], length)
        group = roots()
        ok = (group[x] != group[y]) & ((size[x] < size[y]) | ((size[x] == size[y]) & (x < y))) & (size[x] >= threshold * size[y] - 1e-6)
        pairs = np.setdiff1d(y[ok] * n + x[ok], before)
        yield from ((int(p % n), int(p // n)) for p in pairs)
        before = np.concatenate([before, pairs])
        before = before[before // n == row[asked[to - 1]]]
        k = to


def _verify_local(placed: DataFrame, threshold: float) -> DataFrame:
    """``doc_id``, ``root`` of the rows (comp, doc_id, text, partners); a component's rows lie together in one task."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
        comp, held = None, ([], [], [])
        for batch in batches:
            for part in tb.chunks([batch], "text"):
                sets = _multisets(part.column("text"))
                for c, d, p, s in zip(part.column("comp").to_pylist(), part.column("doc_id").to_pylist(), part.column("partners").to_pylist(), sets):
                    if c != comp and held[0]:
                        yield held
                        held = ([], [], [])
                    comp = c
                    for to, x in zip(held, (d, p or (), s)):
                        to.append(x)
        if held[0]:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for ids, partners, sets in groups(batches):
            at: dict[int, list[int]] = {}
            for k, d in enumerate(ids):
                at.setdefault(d, []).append(k)
            up = {d: d for d in at}

            def find(x: int) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            tried = set()
            for b, others in zip(ids, partners):
                for a in others:
                    x, y = find(a) if a in up else b, find(b)
                    if a in up and x != y and (a, b) not in tried:
                        tried.add((a, b))
                        if any(similarity(sets[i], sets[j]) >= threshold for i in at[a] for j in at[b]):
                            up[max(x, y)] = min(x, y)
            for i, j in _able(sets, lambda: np.array([find(d) for d in ids]), threshold):  # noqa: B023
                a, b = min(ids[i], ids[j]), max(ids[i], ids[j])
                x, y = find(a), find(b)
                if x != y and (a, b) not in tried and similarity(sets[i], sets[j]) >= threshold:
                    up[max(x, y)] = min(x, y)
            for d in at:
                if find(d) != d:
                    out[0].append(d)
                    out[1].append(find(d))
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "root"])
                out = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "root"])

    near = placed.repartition("comp").sortWithinPartitions("comp", "doc_id")
    return near.mapInArrow(run, "doc_id bigint, root bigint")


def _verify_pairs(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.chunks([batch], "left"):
                hit = [similarity(x, y) >= threshold for x, y in zip(_multisets(part.column("left")), _multisets(part.column("right")))]
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(hit)), part.column("b").filter(pa.array(hit))], names=["a", "b"])

    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _able_pairs(texts: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """The pairs a < b of documents of different roots that can reach the threshold, as ``_able`` has them; documents without a root are their own."""
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("root", pa.int64()), ("size", pa.int64()), ("e", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.chunks([batch], "text"):
                size, element = _expand(_multisets(part.column("text")))
                row = pa.array(np.repeat(np.arange(len(size)), size))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in ("doc_id", "tk", "root")), pa.array(size).take(row), pa.array(element.view(np.int64))], schema=schema)

    rooted = texts.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    named = rooted.select("doc_id", F.xxhash64("text").alias("tk"), F.coalesce("root", "doc_id").alias("root"), "text")
    elements = named.mapInArrow(run, "doc_id bigint, tk bigint, root bigint, size bigint, e bigint")
    shared = elements.groupBy("e").agg(F.count("*").alias("many"), (F.min("root") < F.max("root")).alias("differ")).where("many > 1")
    w = Window.partitionBy("doc_id", "tk")
    place = F.col("size") - F.count("*").over(w) + F.row_number().over(w.orderBy("many", "e")) - 1
    asked = cut(elements.join(shared, "e").withColumn("place", place).where(F.col("differ") & (F.col("place") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-6))))
    known = asked.where(F.col("place") <= F.col("size") - F.ceil(2 * threshold / (1 + threshold) * F.col("size") - 1e-6))
    x, y = known.select("e", F.struct("size", "doc_id", "tk").alias("x"), F.col("root").alias("rx")), asked.select("e", F.struct("size", "doc_id", "tk").alias("y"), F.col("root").alias("ry"))
    both = x.join(y, "e").where(F.col("x") < F.col("y")).where("rx <> ry").where(F.col("x.size") >= threshold * F.col("y.size") - 1e-6)
    return both.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def groups(documents: DataFrame, threshold: float = THRESHOLD, registers: int = REGISTERS, rows: int = ROWS, local_triples: int = LOCAL_TRIPLES) -> DataFrame:
    """``doc_id``, ``kept_id`` for each document that goes; ``kept_id`` is the least id of its group, which stays."""
    spark = documents.sparkSession
    folder = scratch(spark, "sketch")
    sketch(documents, registers, rows).write.parquet(folder)
    sketches = spark.read.parquet(folder)
    equal = sketches.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    member = cut(sketches.select("doc_id", "k1", "k2").join(equal, ["k1", "k2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    lead = sketches.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "triples", "bands")).alias("s")).select("s.*")
    pairs = cut(candidates(lead))
    comp = components(pairs)
    held = sketches.join(comp, F.col("doc_id") == F.col("node")).groupBy("root").agg(F.sum("triples").alias("size"))
    placed = cut(comp.join(held, "root"))
    text = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partners = pairs.groupBy(F.col("b").alias("doc_id")).agg(F.sort_array(F.collect_list("a")).alias("partners"))
    small = placed.where(F.col("size") <= local_triples).select(F.col("node").alias("doc_id"), F.col("root").alias("comp")).join(partners, "doc_id", "left")
    linked = _verify_local(text.join(small, "doc_id").select("comp", "doc_id", "text", "partners"), threshold).select(F.col("root").alias("a"), F.col("doc_id").alias("b"))
    large = cut(placed.where(F.col("size") > local_triples).select(F.col("node").alias("doc_id")))
    if not large.isEmpty():
        wide = pairs.join(large.withColumnRenamed("doc_id", "b"), "b", "left_semi")
        texts = text.join(large, "doc_id", "left_semi")
        near = cut(_verify_pairs(wide, texts, threshold))
        linked = linked.unionByName(near).unionByName(_verify_pairs(_able_pairs(texts, components(near), threshold), texts, threshold))
    linked = cut(linked.unionByName(member))
    return components(linked).where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"))


def keep_one(documents: DataFrame, found: DataFrame | None = None, **options) -> DataFrame:
    """The rows of the documents that stay, with all their columns; of rows with equal id and text one stays.

    That is the one whose columns come first as JSON. Rows without id stay.
    """
    out, twice, n = free_names(documents, "gone", "twice", "n")
    gone = (groups(documents, **options) if found is None else found).select(F.col("doc_id").alias(out))
    many = documents.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(n)).where(F.col(n) > 1).select(F.col("doc_id").alias(twice))
    kept = documents.join(gone, documents["doc_id"].cast("bigint") == gone[out], "left_anti")
    marked = kept.join(many, F.col("doc_id") == F.col(twice), "left")
    once = marked.where(F.col(twice).isNull()).drop(twice)
    w = Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns])))
    again = marked.where(F.col(twice).isNotNull()).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n, twice)
    return once.unionByName(again)
