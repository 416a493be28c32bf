"""Exact top-k inner products of some rows of a table with all its others.

Vectors are rotated by the eigenvectors of their second moments (the right singular vectors of the table, from one
distributed Gram sum), written to the shared folder in blocks by descending norm, and read block by block by each
group of queries. Partial sums over the leading rotated axes, with Cauchy-Schwarz bounds on the rest, rule vectors
out against each query's k-th product so far; a group ends its pass when the next block's largest norm cannot
matter any more. What is left is compared by the exact product of the vectors as they are, in double precision.

No vector is broadcast and no task holds more than two blocks. Ties go to the least id, and products are exact up to
double rounding. Defined results: rows with a null id, a null vector, a null or non-finite component are left out; a
product is that of two vectors of one length, so vectors of each length are searched among themselves; a row is not
its own neighbour, but other rows of equal id are; fewer than k neighbours give fewer rows; empty tables give empty
results; extra columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, scratch

K, BLOCK_ROWS, LEADING, TILE_ROWS = 10, 4096, 0.25, 512
_SLACK = 1e-4


def _vectors(embeddings: DataFrame) -> tuple[DataFrame, list[int]]:
    """``id``, ``v`` of the rows that count, and the lengths of their vectors."""
    usable = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = usable.where("id is not null and v is not null and size(v) > 0").where(~bad)
    return usable, sorted(r["d"] for r in usable.select(F.size("v").alias("d")).distinct().collect())


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of the table, by descending singular value; one d x d matrix a task goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for b in batches:
            x = _matrix(b.column(0), d)
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * d), pa.array(gram.ravel()))], names=["i", "row"])

    sums = vectors.select("v").mapInArrow(run, "i bigint, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    gram = np.zeros((d, d))
    gram[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["x"].to_numpy()
    value, vector = np.linalg.eigh(gram)
    return vector[:, np.argsort(-value, kind="stable")]


def block_order(path: str) -> tuple[int, int]:
    """Partition and number in the partition of a written file: the names themselves stop being in order at a thousand."""
    part, number = re.search(r"part-(\d+)-.*-c(\d+)", path).groups()
    return int(part), int(number)


def top_k(embeddings: DataFrame, k: int = K, queries: str | None = None, block_rows: int = BLOCK_ROWS, leading: float = LEADING) -> DataFrame:
    """``vec_id``, ``rank`` from 1, ``neighbour_id``, ``score``: the k largest products of vectors with the others.

    ``queries`` is a condition on ``id`` that says which rows are asked for; None asks for all. Every row is searched.
    """
    vectors, lengths = _vectors(embeddings)
    found = [_top_k(vectors.where(F.size("v") == d), d, k, queries, block_rows, leading) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else embeddings.sparkSession.createDataFrame([], _SCHEMA)


_SCHEMA = "vec_id bigint, rank int, neighbour_id bigint, score double"


def _top_k(vectors: DataFrame, d: int, k: int, asked: str | None, block_rows: int, leading: float) -> DataFrame:
    spark = vectors.sparkSession
    turn, lead = rotation(vectors, d), max(1, int(d * leading))
    uri = scratch(spark, "vectors")
    normed = vectors.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    normed.orderBy(F.desc("norm"), "id").write.option("parquet.block.size", str(block_rows * d * 8)).option("maxRecordsPerFile", block_rows).parquet(uri)
    shared = spark.sparkContext.broadcast(turn)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        import pyarrow.parquet as pq

        from pyarrow import fs

        system, path = file_system(uri)
        last = np.inf
        for f in sorted((f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")), key=block_order):
            t = pq.read_table(f, filesystem=system)
            if t.num_rows:
                if t["norm"][0].as_py() > last:
                    raise ValueError(f"{f} is out of order")
                last = t["norm"][t.num_rows - 1].as_py()
                yield t["id"].to_numpy(), _matrix(t["v"].combine_chunks(), d), t["norm"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotate = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, block_rows):
                part = b.slice(lo, block_rows)
                ids, q = part.column("id").to_numpy(), _matrix(part.column("v"), d)
                yield _search(ids, q, rotate, lead, k, blocks())

    rows = spark.read.parquet(uri)
    if asked is not None:  # few of each block: those of like norm go together, so that blocks are read less often
        rows = rows.where(asked)
        groups = max(-(-rows.count() // block_rows), spark.sparkContext.defaultParallelism)
        rows = rows.repartitionByRange(groups, F.desc("norm"), "id")
    return rows.select("id", "v").mapInArrow(run, _SCHEMA)


def _search(ids: np.ndarray, q: np.ndarray, rotate: np.ndarray, lead: int, k: int, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The k best of each query over blocks of descending norm."""
    n, d = q.shape
    r = q @ rotate
    norm = np.linalg.norm(q, axis=1)
    best = np.full((n, k), -np.inf)
    found = np.full((n, k), np.iinfo(np.int64).max)
    own = np.zeros(n, bool)  # each query skips one row that equals it
    cuts = sorted({*range(lead, d, lead), d})
    for at, x, size in blocks:
        margin = _SLACK * 1e-6 * norm * size.max()
        alive = np.flatnonzero(best[:, -1] <= norm * size.max() + margin)
        if not len(alive):
            break
        y = x @ rotate
        for lo in range(0, len(alive), TILE_ROWS):
            rows = alive[lo : lo + TILE_ROWS]
            rows, cols, i, j = _survivors(r[rows], y, best[rows, -1], margin[rows], cuts, min(k + 1, len(at)), rows)
            if len(i):
                _merge(best, found, own, ids, q, at, x, rows[i], cols[j], k)
    got = best > -np.inf
    i, rank = np.nonzero(got)
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array((rank + 1).astype(np.int32)), pa.array(found[got]), pa.array(best[got])], names=["vec_id", "rank", "neighbour_id", "score"])


def _survivors(r: np.ndarray, y: np.ndarray, floor: np.ndarray, margin: np.ndarray, cuts: list[int], most: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that partial sums and Cauchy-Schwarz bounds on the rest don't rule out; columns and rows without any go first."""
    cols, partial, low = np.arange(len(y)), np.zeros((len(r), len(y))), 0
    for cut in cuts:
        partial += r[:, low:cut] @ y[cols, low:cut].T
        low = cut
        rest = np.linalg.norm(r[:, cut:], axis=1)[:, None] * np.linalg.norm(y[cols, cut:], axis=1)[None, :]
        open_ = np.isinf(floor)
        if open_.any() and len(cols) >= most:  # the k + 1 least certain products of this block are a floor too
            sure = np.partition(partial[open_] - rest[open_], len(cols) - most, axis=1)[:, len(cols) - most]
            floor = floor.copy()
            floor[open_] = np.where(np.isinf(floor[open_]), sure - margin[open_], floor[open_]) if cut == cuts[-1] else floor[open_]
            bar = floor.copy()
            bar[open_] = sure - margin[open_]
        else:
            bar = floor
        hit = partial + rest + margin[:, None] >= bar[:, None]
        if cut == cuts[-1]:
            i, j = np.nonzero(hit)
            return rows, cols, i, j
        some, whose = hit.any(0), hit.any(1)
        if not some.all() or not whose.all():
            cols, partial = cols[some], partial[np.ix_(whose, some)]
            r, floor, margin, rows = r[whose], floor[whose], margin[whose], rows[whose]
        if not len(cols):
            return rows, cols, np.empty(0, np.int64), np.empty(0, np.int64)
    raise AssertionError("the last cut is the length of the vectors")


def _merge(best: np.ndarray, found: np.ndarray, own: np.ndarray, ids: np.ndarray, q: np.ndarray, at: np.ndarray, x: np.ndarray, qi: np.ndarray, j: np.ndarray, k: int) -> None:
    """Takes the exact products of some pairs into the best of their queries."""
    score = np.einsum("ij,ij->i", q[qi], x[j])
    for s in np.flatnonzero(ids[qi] == at[j]):
        if not own[qi[s]] and np.array_equal(q[qi[s]], x[j[s]]):
            own[qi[s]] = True
            score[s] = -np.inf
    keep = score > -np.inf
    qi, j, score = qi[keep], j[keep], score[keep]
    touched = np.unique(qi)
    who = np.concatenate([np.repeat(touched, k), qi])
    val = np.concatenate([best[touched].ravel(), score])
    nid = np.concatenate([found[touched].ravel(), at[j]])
    o = np.lexsort((nid, -val, who))
    pick = np.searchsorted(who[o], touched)[:, None] + np.arange(k)[None, :]
    best[touched], found[touched] = val[o][pick], nid[o][pick]
