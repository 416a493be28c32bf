"""Line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is 128 bits of two hashes with seeds of their own. An index has shards by key; each has an exact table
(key, number of occurrences) and a cuckoo filter of its keys with 16-bit fingerprints. The number of shards follows the
number of lines: an insertion that would fill them deals the tables out anew, so that no shard grows with the data.
Inserting documents counts their lines: a line that the
filter does not know is new for sure and its first occurrence (least id, text hash, place) stays; one that it may
know is looked up in the table. All other occurrences go. Deleting documents takes their counts off again; a key
that reaches 0 leaves the table and the filter, so an index after insertions and the deletion of some of them is the
index of what is left; deleting lines that were not inserted is an error. Each change writes a new version of the index in the shared folder, and a lost executor only
means that a shard is computed again.

Defined results: null texts stay null and empty ones empty; blank lines are no lines, and go with the lines that a
document loses; rows that repeat id and text get the same result; rows with null ids come last in the order; extra
columns stay in ``keep`` and play no part in ``dedup``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_names, scratch
from .textbatch import mix

LINES_PER_SHARD = 1_000_000
_STATE = "kind int, shard int, k1 bigint, k2 bigint, refs bigint, did bigint, rk bigint, pos int, filter binary"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_TABLE, _FILTER, _OWNER = 1, 2, 3


class Cuckoo:
    """A cuckoo filter of 64-bit keys: buckets of four 16-bit fingerprints, all operations over arrays."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def of(cls, keys: np.ndarray) -> "Cuckoo":
        buckets = 1 << int(max(1, len(keys)) / 4 / 0.85).bit_length()
        while True:
            made = cls(np.zeros((buckets, 4), np.uint16))
            if made.insert(keys):
                return made
            buckets *= 2

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.view(np.uint64))
        mark = np.maximum((h >> np.uint64(48)).astype(np.uint16), 1)
        one = (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """Adds different keys; False if they don't fit, when the filter must be made anew, larger."""
        mark, at, other = self._where(keys)
        for turn in range(rounds):
            if not len(mark):
                return True
            order = np.argsort(at, kind="stable")
            mark, at, other = mark[order], at[order], other[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            free = self.slots[at] == 0
            fits = rank < free.sum(1)
            slot = np.argmax(np.cumsum(free[fits], 1) == (rank[fits] + 1)[:, None], axis=1)
            self.slots[at[fits], slot] = mark[fits]
            mark, at, other = mark[~fits], at[~fits], other[~fits]
            if turn and len(mark):  # one key of a bucket takes the place of another, which goes to its other bucket
                _, kick = np.unique(at, return_index=True)
                where = (turn + at[kick]) % 4
                gone = self.slots[at[kick], where].copy()
                self.slots[at[kick], where] = mark[kick]
                rest = np.ones(len(mark), bool)
                rest[kick] = False
                moved = self._other(at[kick], gone)
                mark, at, other = np.append(mark[rest], gone), np.append(other[rest], moved), np.append(at[rest], at[kick])
            else:
                at, other = other, at
        return not len(mark)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._where(keys)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Takes off keys that were added."""
        mark, one, two = self._where(keys)
        for second in (False, True):
            at = two if second else one
            todo = np.arange(len(mark))
            while len(todo):
                _, k = np.unique(at[todo], return_index=True)
                now = todo[k]
                same = self.slots[at[now]] == mark[now][:, None]
                hit = same.any(1)
                self.slots[at[now[hit]], np.argmax(same[hit], 1)] = 0
                mark[now[hit]] = 0
                todo = np.setdiff1d(todo, now)
            left = mark != 0
            mark, two = mark[left], two[left]


def lines(documents: DataFrame) -> DataFrame:
    """``did``, ``rk``, ``pos``, ``k1``, ``k2`` of every line that is not blank; a hash seeds the next, so k2 has the line last."""
    keyed = documents.select(*_row_key(documents), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line"))
    return keyed.where(F.trim("line") != "").select("did", "rk", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _row_key(documents: DataFrame) -> list:
    return [F.coalesce(documents["doc_id"].cast("bigint"), F.lit((1 << 63) - 1)).alias("did"), F.xxhash64(documents["text"].cast("string"), documents["doc_id"].isNull()).alias("rk")]


def _shard(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod("k2", F.lit(shards)).cast("int"))


class LineIndex:
    """An index of lines in a folder; ``version`` is None while it is empty."""

    def __init__(self, spark: SparkSession, shards: int, version: str | None = None, lines_per_shard: int = LINES_PER_SHARD):
        self.spark, self.shards, self.version, self.lines_per_shard = spark, shards, version, lines_per_shard

    @classmethod
    def sized(cls, documents: DataFrame, lines_per_shard: int = LINES_PER_SHARD) -> "LineIndex":
        """An empty index with shards for about as many lines as the documents have, and for all cores."""
        spark = documents.sparkSession
        return cls(spark, max(3 * spark.sparkContext.defaultParallelism, _shards(documents, 0, lines_per_shard)), None, lines_per_shard)

    def _rows(self, kind: int) -> DataFrame:
        return self.spark.read.schema(_STATE).parquet(self.version).where(F.col("kind") == kind)

    def counts(self) -> DataFrame:
        """``k1``, ``k2``, ``refs``: the exact table."""
        if self.version is None:
            return self.spark.createDataFrame([], "k1 bigint, k2 bigint, refs bigint")
        return self._rows(_TABLE).select("k1", "k2", "refs")

    def _change(self, documents: DataFrame, sign: int, shards: int) -> "LineIndex":
        seen = lines(documents).groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.min(F.struct("did", "rk", "pos")).alias("o"))
        new = _shard(seen, shards).select(F.lit(0).alias("kind"), "shard", "k1", "k2", (sign * F.col("refs")).alias("refs"), "o.did", "o.rk", "o.pos", F.lit(None).cast("binary").alias("filter"))
        if self.version is not None:
            old = self.spark.read.schema(_STATE).parquet(self.version)
            new = new.unionByName(old.where(F.col("kind") != _OWNER) if shards == self.shards else _shard(old.where(F.col("kind") == _TABLE), shards).select(*_NAMES))
        folder = scratch(self.spark, "lines")
        new.groupBy("shard").applyInArrow(_apply, _STATE).write.parquet(folder)
        return LineIndex(self.spark, shards, folder, self.lines_per_shard)

    def insert(self, documents: DataFrame) -> "LineIndex":
        if self.version is None:
            return self._change(documents, 1, self.shards)
        return self._change(documents, 1, max(self.shards, _shards(documents, self._rows(_TABLE).count(), self.lines_per_shard)))

    def delete(self, documents: DataFrame) -> "LineIndex":
        """The index without documents that were inserted, given with their texts as they were."""
        return self._change(documents, -1, self.shards)

    def owners(self) -> DataFrame:
        """``did``, ``rk``, ``kept``: the places of the lines that stay, of the documents that were inserted last."""
        return self._rows(_OWNER).groupBy("did", "rk").agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def _shards(documents: DataFrame, held: int, lines_per_shard: int) -> int:
    """The number of shards for the lines of the documents and those that an index holds."""
    text = F.col("text").cast("string")
    n = documents.agg(F.sum(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)).first()[0] or 0
    return max(1, -(-(int(n) + held) // lines_per_shard))


def _apply(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: its table and filter, with the counts of a batch of lines added or taken off."""
    t = pa.Table.from_batches(list(batches))
    kind, shard = t["kind"].to_numpy(), int(key[0].as_py())
    old, batch = t.filter(pa.array(kind == _TABLE)), t.filter(pa.array(kind == 0))
    k1, k2, refs = (old[c].to_numpy().copy() for c in ("k1", "k2", "refs"))
    order = np.argsort(k1, kind="stable")
    k1, k2, refs = k1[order], k2[order], refs[order]
    held = t.filter(pa.array(kind == _FILTER))["filter"].to_pylist()
    cuckoo = Cuckoo(np.frombuffer(held[0], np.uint16).reshape(-1, 4).copy()) if held else Cuckoo.of(k1)
    b1, b2, change = (batch[c].to_numpy() for c in ("k1", "k2", "refs"))
    maybe = np.flatnonzero(cuckoo.contains(b1)) if len(b1) else np.empty(0, np.int64)
    place = np.full(len(b1), -1)
    if len(k1):
        at, last = np.searchsorted(k1, b1[maybe]), np.searchsorted(k1, b1[maybe], "right")
        while (at < last).any():
            in_range = at < last
            hit = in_range & (k2[np.minimum(at, len(k2) - 1)] == b2[maybe])
            place[maybe[hit]] = at[hit]
            at = at + 1
    known = place >= 0
    np.add.at(refs, place[known], change[known])
    fresh = ~known & (change > 0)
    gone = refs <= 0
    if (~known & (change < 0)).any() or (refs < 0).any():
        raise ValueError("lines are to be deleted that were not inserted")
    if gone.any():
        cuckoo.delete(k1[gone])
    if fresh.any() and not cuckoo.insert(b1[fresh]):
        cuckoo = Cuckoo.of(np.concatenate([k1[~gone], b1[fresh]]))
    n1, n2, nr = np.concatenate([k1[~gone], b1[fresh]]), np.concatenate([k2[~gone], b2[fresh]]), np.concatenate([refs[~gone], change[fresh]])
    own = batch.filter(pa.array(fresh))
    nothing = lambda n, kind: pa.nulls(n, kind)
    yield _state(_TABLE, shard, len(n1), k1=pa.array(n1), k2=pa.array(n2), refs=pa.array(nr))
    yield _state(_FILTER, shard, 1, filter=pa.array([cuckoo.slots.tobytes()], pa.binary()))
    yield _state(_OWNER, shard, own.num_rows, **{c: own[c].combine_chunks() if own.num_rows else nothing(0, k) for c, k in zip(_NAMES, _TYPES) if c in ("did", "rk", "pos")})


def _state(kind: int, shard: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    columns |= {"kind": pa.array(np.full(n, kind, np.int32)), "shard": pa.array(np.full(n, shard, np.int32))}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(_NAMES, _TYPES)], schema=pa.schema(list(zip(_NAMES, _TYPES))))


def _cleaned(documents: DataFrame, index: LineIndex) -> tuple[DataFrame, str, str, str]:
    """The documents with three more columns: the text that stays and the numbers of lines and of those that stay."""
    did, rk, pos, parts, n, kept, text = free_names(documents, "did", "rk", "pos", "parts", "n_lines", "n_kept", "cleaned")
    keys = _row_key(documents)
    keyed = documents.withColumns({did: keys[0], rk: keys[1]})
    own = index.owners().select(F.col("did").alias(did), F.col("rk").alias(rk), F.col("kept").alias(pos))
    joined = keyed.join(own, [did, rk], "left").withColumn(parts, F.split(F.col("text").cast("string"), "\n", -1))
    joined = joined.withColumn(n, F.greatest(F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x) != "")), F.lit(0)), F.lit(0)))
    joined = joined.withColumn(kept, F.greatest(F.coalesce(F.size(pos), F.lit(0)), F.lit(0)))
    rebuilt = F.coalesce(F.expr(f"array_join(transform(`{pos}`, p -> `{parts}`[p]), '\n')"), F.lit(""))
    joined = joined.withColumn(text, F.when(F.col(kept) == F.col(n), F.col("text").cast("string")).otherwise(rebuilt))
    return joined.drop(did, rk, pos, parts), text, n, kept


def dedup(documents: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """``doc_id``, the ``text`` that stays, ``n_lines`` and ``n_removed``; the documents are inserted into the index."""
    index = (index or LineIndex.sized(documents)).insert(documents)
    found, text, n, kept = _cleaned(documents.select("doc_id", "text"), index)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(n).alias("n_lines"), (F.col(n) - F.col(kept)).alias("n_removed"))


def keep(documents: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """The documents with the lines that stay and all their columns; those that lose every line go."""
    index = (index or LineIndex.sized(documents)).insert(documents)
    found, text, n, kept = _cleaned(documents, index)
    found = found.where((F.col(kept) > 0) | (F.col(n) == 0))
    size = {"n_chars": F.length(text).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {}
    return found.withColumns({"text": F.col(text), **size}).select(*[F.col(f"`{c}`") for c in documents.columns])
