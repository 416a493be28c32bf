"""Byte-level BPE: ranked merges folded by higher-order functions over the byte arrays of distinct words.

Texts are cut into words by the usual pattern of byte-level vocabularies (contractions, letters, numbers, other
signs, each with one space before it, and white space), vectorised over code points. A chunk of documents becomes
one row: the byte arrays of its distinct words and, for each document, the places of its words among them. Spark
folds the merges over every distinct word once: in each step the leftmost pair of least rank becomes one symbol,
and the ranks of its two new pairs are looked up. Decoding concatenates the binary pieces of symbols. Documents are
put together from their words' symbols and pieces in the same row, so no document is shuffled. Words are told apart
by their bytes; hashes only bring equal ones together.

Two kinds of words are not folded again in each chunk; they get the same symbols as the others. Words that are
frequent in a hash sample of the documents are folded once, ``cached_words`` at most, and read by all tasks from
the shared folder; which
words these are has no effect on results. Words of more than ``LONG`` bytes, for which a fold over arrays would take
quadratic time, are merged with a heap.

The rank map is a one-row literal: pairs of symbols are laid out in two hashed halves, so that a rank is found in at
most two places of an array (Spark's own maps are searched from end to end). It is as large as the vocabulary,
whatever the data.

Defined results: a null text has null ids, null count and null decoding; an empty one has no ids; every input row
gives one output row, repeated rows too; a null id stays null; extra columns play no part; an empty table gives an
empty result. Invalid UTF-8 cannot occur in a string column, and decoding gives back every text as it was.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import file_system, release, scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK_BYTES, SLICE_BYTES = 3 << 20, 1 << 19
CACHED_WORDS, SAMPLED = 1 << 19, 16
LONG = 64
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASSES: list[np.ndarray] = []
_MULTIPLIER = 1_000_003


@lru_cache(maxsize=4)
def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Pieces and ranks of a vocabulary file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def rank_map(path: str = VOCABULARY) -> tuple[np.ndarray, int]:
    """Pairs of symbols and the ranks of what they make, as an array of two hashed halves; the size of a half.

    An entry is the pair (left symbol, right symbol) and the rank, 16 bits each; -1 where the place is free.
    """
    ranks = load_ranks(path)
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("the vocabulary has more than 65,536 pieces")
    pairs = {(ranks[p[:i]] << 16) | ranks[p[i:]]: r for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks}
    half = max(1021, int(len(pairs) * 1.3)) | 1
    while True:
        table, fits = [-1] * (2 * half), True
        for key, rank in pairs.items():
            entry, side = (key << 16) | rank, 0
            for _ in range(500):
                k = entry >> 16
                at = k % half if side == 0 else half + (k * _MULTIPLIER) % (half - 2)
                entry, table[at] = table[at], entry
                if entry < 0:
                    break
                side = 1 - side
            else:
                fits = False
                break
        if fits:
            return np.array(table, np.int64), half
        half += 2 * (half // 20) + 2


def _classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    if not _CLASSES:
        found = np.zeros(0x110000, np.uint8)
        kinds = {"L": 1, "N": 2}
        found[:] = [kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)]
        found[_WHITE] = 3
        _CLASSES.append(found)
    return _CLASSES[0]


def split_words(data: np.ndarray, row_bytes: np.ndarray) -> np.ndarray:
    """Byte places at which the words of some texts begin, ascending; texts are covered without gaps."""
    if not len(data):
        return np.empty(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(place, row_bytes)] = True
    first, end = first[:n], first[1:].copy()
    end[-1] = True
    white = kind == 3
    before = np.concatenate([[255], kind[:-1]])
    start = first | (kind != before)
    last_white = np.zeros(n, bool)  # white space just before something else of the same text
    last_white[:-1] = white[:-1] & ~white[1:] & ~end[:-1]
    joins = last_white & (points == 32)  # ... and a space: it begins the next word
    start |= last_white
    follow = np.flatnonzero(joins) + 1
    start[follow] = False
    # contractions: an apostrophe that begins a word and is followed by one of s, t, m, d, re, ve, ll
    mark = np.flatnonzero((points == 39) & start & ~end)
    if len(mark):
        nxt, nxt2 = points[mark + 1], np.where(end[mark + 1], 0, points[np.minimum(mark + 2, n - 1)])
        one = np.isin(nxt, [115, 116, 109, 100])
        two = ((nxt == 114) & (nxt2 == 101)) | ((nxt == 118) & (nxt2 == 101)) | ((nxt == 108) & (nxt2 == 108))
        start[mark[one | two] + 1] = False
        for take, wide in ((one, 2), (two, 3)):
            rest = mark[take & ~one] + wide if wide == 3 else mark[take] + wide
            rest = rest[rest < n]
            start[rest] = True
    return place[start]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The symbols of one word, by a heap of its pairs in O(n log n)."""
    part: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(ranks[p], i) for i in range(len(word) - 1) if (p := word[i : i + 2]) in ranks]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if part[i] is None or j >= len(word) or ranks.get(part[i] + part[j]) != rank:
            continue
        part[i] += part[j]
        part[j] = None
        after[i] = after[j]
        if after[j] < len(word):
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < len(word) and (r := ranks.get(part[x] + part[y])) is not None:
                heappush(heap, (r, x))
    return [ranks[p] for p in part if p is not None]


def _lists(size: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))


def _spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of an array that begin at ``start``, one after the other."""
    edge = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(start - edge[:-1], size) + np.arange(edge[-1])] if edge[-1] else flat[:0]


def _slices(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of some texts, nulls as empty: bytes, row offsets, word starts, word ends."""
    batch = pa.RecordBatch.from_arrays([pc.fill_null(text, "").cast(pa.large_string())], names=["text"])
    for part in tb.chunks([batch], "text", SLICE_BYTES):
        data, off = tb.text_bytes(part.column(0))
        starts = split_words(data, off)
        yield data, off, starts, np.append(starts[1:], len(data)).astype(np.int64)


def _chunk_rows(batches: Iterator[pa.RecordBatch], limit: int, path: str, cache: str | None) -> Iterator[pa.RecordBatch]:
    """Chunks of documents as rows.

    ``known`` has words as arrays of their own symbols, ``words`` those to fold, as arrays of the symbols of their
    bytes with their places (see ``fold_sql``); places of words in documents run through the one and then the other.
    """
    ranks, known = load_ranks(path), load_cache(cache) if cache else None
    symbol = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    for part in tb.chunks(batches, "text", limit):
        text = part.column("text")
        null = text.is_null().to_numpy(zero_copy_only=False)
        places, pools, sizes, counts, seen = [], [], [], [], 0
        for data, off, starts, ends in _slices(text):
            _, at, place = tb.distinct(data, starts, ends)
            size = (ends - starts)[at]
            places.append((place + seen).astype(np.int32))
            pools.append(_spread(data, starts[at], size))
            sizes.append(size)
            counts.append(np.diff(np.searchsorted(starts, off)))
            seen += len(at)
        pool, size = np.concatenate(pools), np.concatenate(sizes)
        begin = np.cumsum(size) - size
        h, at, place = tb.distinct(pool, begin, begin + size)
        begin, size = begin[at], size[at]
        places = place.astype(np.int32)[np.concatenate(places)]
        del pools, sizes, place
        fold = size <= LONG
        spelled = [np.array(merge_long(pool[begin[k] : begin[k] + size[k]].tobytes(), ranks), np.int32) for k in np.flatnonzero(~fold)]
        extra = np.concatenate([np.empty(0, np.int32), *spelled])
        begin[~fold], size[~fold] = np.cumsum([0, *map(len, spelled)])[:-1], list(map(len, spelled))
        if known is not None and len(known[0]) and len(h):
            k = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
            hit = np.flatnonzero((known[0][k] == h) & fold & (known[4][k + 1] - known[4][k] == size))
            hit = hit[tb.equal_spans(pool, begin[hit], known[3], known[4][k[hit]].astype(np.int64), size[hit])]
            size[hit] = known[1][k[hit] + 1] - known[1][k[hit]]
            begin[hit] = len(extra) + np.cumsum(size[hit]) - size[hit]
            fold[hit] = False
            extra = np.concatenate([extra, _spread(known[2], known[1][k[hit]].astype(np.int64), size[hit]).astype(np.int32)])
        whole, parts = np.flatnonzero(~fold), np.flatnonzero(fold)
        moved = np.empty(len(h), np.int32)
        moved[whole], moved[parts] = np.arange(len(whole)), len(whole) + np.arange(len(parts))
        n = size[parts]
        flat = symbol[_spread(pool, begin[parts], n)]
        flat |= (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32) << 16
        doc = _lists(np.concatenate(counts), moved[places])
        doc = pc.if_else(pa.array(null), pa.scalar(None, doc.type), doc) if null.any() else doc
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        row = pa.RecordBatch.from_arrays([one(part.column("doc_id")), one(doc), one(_lists(size[whole], _spread(extra, begin[whole], size[whole]))), one(_lists(n, flat))], names=["ids", "docs", "known", "words"])
        del text, data, off, starts, ends, h, at, places, pool, begin, size, extra, flat, doc, part, moved, whole, parts, n, fold
        yield row
        del row
        release(collect=False)  # workers share an executor's memory with a large heap


#: Of a bigint of the folded state: the symbol in 16 bits, its place in 28, the rank of its pair with the next in 17.
_NONE = 65536
_RANK = (
    "case when shiftright(m.t[int(k % {half})], 16) = k then m.t[int(k % {half})] & 65535"
    " when shiftright(m.t[int({half} + k * {mul} % {less})], 16) = k then m.t[int({half} + k * {mul} % {less})] & 65535 else 65536L end"
)


def fold_sql(half: int, word: str = "w") -> str:
    """The SQL of the symbols of a word; ``m.t`` is the rank map.

    A word is an array of the symbols of its bytes and, 16 bits higher, their places.

    The folded state has an integer for each symbol: the rank of its pair with the next, its place, the symbol. The
    least integer is the leftmost pair of least rank; a merge looks up two new pairs.
    """
    rank = _RANK.format(half=half, mul=_MULTIPLIER, less=half - 2)
    look = lambda left, right: f"element_at(transform(array(({left}) * 65536 | ({right})), k -> {rank}), 1)"
    begin = f"zip_with({word}, transform(zip_with({word}, slice({word}, 2, size({word})), (a, b) -> bigint(a & 65535) * 65536 | (b & 65535)), k -> {rank}), (v, r) -> shiftleft(r, 44) | v)"
    changed = (
        "case when i > p + 1 then v - 65536 when i < p - 1 then v "
        f"when i = p - 1 then shiftleft({look('v & 65535', 'q')}, 44) | (v & 17592186044415) "
        f"when i = p then if(i + 2 < size(acc), shiftleft({look('q', 'acc[i + 2] & 65535')}, 44), {_NONE << 44}L) | shiftleft(bigint(i), 16) | q "
        "else -1L end"
    )
    merge = f"transform(array(int(shiftright(low, 16) & 268435455)), p -> transform(array(shiftright(low, 44)), q -> array_remove(transform(acc, (v, i) -> {changed}), -1L))[0])[0]"
    step = f"transform(array(array_min(acc)), low -> if(low >= {_NONE << 44}L, acc, {merge}))[0]"
    fold = f"aggregate(slice({word}, 2, size({word})), {begin}, (acc, x) -> {step}, acc -> transform(acc, v -> int(v & 65535)))"
    return fold


def _literals(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """One row: the rank map and the pieces of symbols, one character a byte."""
    ranks, (table, half) = load_ranks(path), rank_map(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for p, r in ranks.items():
        pieces[r] = p.decode("latin-1")
    row = {"table": pa.array([table.tolist()], pa.list_(pa.int64())), "pieces": pa.array([pieces], pa.list_(pa.string()))}
    return spark.createDataFrame(pa.table(row)), half


def pieces_sql(symbols: str) -> str:
    """The SQL of the bytes of some symbols, one character a byte: their pieces, concatenated."""
    return f"array_join(transform({symbols}, s -> pieces[s]), '')"


def bytes_sql(characters: str) -> str:
    return f"encode({characters}, 'ISO-8859-1')"


_CHUNK = "ids array<bigint>, docs array<array<int>>, known array<array<int>>, words array<array<int>>"
_FOLDED = "transform(array(named_struct('t', table)), m -> transform(words, w -> {}))[0]"


def cache_words(documents: DataFrame, path: str = VOCABULARY, most: int = CACHED_WORDS) -> str:
    """Writes hashes and symbols of the words of at most ``LONG`` bytes that are most frequent in a sample; the folder."""
    spark = documents.sparkSession
    literals, half = _literals(spark, path)
    sample = documents.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select(F.col("text").cast("string").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, _, starts, ends in (x for batch in batches for x in _slices(batch.column("text"))):
            short = ends - starts <= LONG
            starts, ends = starts[short], ends[short]
            _, at, place = tb.distinct(data, starts, ends)
            count, size = np.bincount(place, minlength=len(at)), (ends - starts)[at]
            edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            flat = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(_spread(data, starts[at], size).tobytes())])
            yield pa.RecordBatch.from_arrays([flat, pa.array(count.astype(np.int64))], names=["word", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        symbol = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        for batch in batches:
            data, off = tb.text_bytes(batch.column("word"))
            size = np.diff(off)
            flat = symbol[data] | ((np.arange(len(data)) - np.repeat(off[:-1], size)) << 16).astype(np.int32)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([one(pa.array(tb.span_hashes(data, off[:-1], off[1:]).view(np.int64))), one(batch.column("word")), one(_lists(size, flat))], names=["ks", "bytes", "words"])

    top = sample.mapInArrow(words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word")
    chunks = top.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(rows, "ks array<bigint>, bytes array<binary>, words array<array<int>>")
    folder = scratch(spark, "words")
    done = chunks.crossJoin(F.broadcast(literals)).select(F.explode(F.expr(f"arrays_zip(ks, bytes, {_FOLDED.format(fold_sql(half))})")).alias("r"))
    done.select(F.col("r").getField("ks").alias("k"), F.col("r").getField("bytes").alias("w"), F.col("r").getField("2").alias("s")).write.parquet(folder)
    return folder


@lru_cache(maxsize=1)
def load_cache(folder: str) -> tuple[np.ndarray, ...]:
    """Hashes, ascending, of the cached words, the edges and values of their symbols, and their bytes and the edges of these."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, place = file_system(folder)
    files = [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")]
    t = pa.concat_tables([pq.read_table(f, filesystem=system) for f in files])
    hashes = t["k"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    lists = t["s"].combine_chunks()
    first, size = lists.offsets.to_numpy()[:-1], pc.list_value_length(lists).to_numpy()
    made = hashes[order], np.concatenate([[0], np.cumsum(size[order])]).astype(np.int32), _spread(lists.values.to_numpy().astype(np.uint16), first[order], size[order])
    letters, edge = tb.text_bytes(t["w"])
    size = np.diff(edge)[order]
    made += _spread(letters, edge[:-1][order], size), np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    del t, lists, letters, edge, hashes, order, first, size
    release()
    return made


def encode(documents: DataFrame, path: str = VOCABULARY, chunk_bytes: int = CHUNK_BYTES, cached_words: int = CACHED_WORDS) -> DataFrame:
    """``doc_id``, ``tokens``, ``n_tokens`` and ``decoded``, the text that decoding the tokens gives back."""
    spark = documents.sparkSession
    literals, half = _literals(spark, path)
    cache = cache_words(documents, path, cached_words) if cached_words else None
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = rows.mapInArrow(lambda batches: _chunk_rows(batches, chunk_bytes, path, cache), _CHUNK)
    folded = f"transform(array(concat(known, {_FOLDED.format(fold_sql(half))})), ws -> named_struct('s', ws, 't', transform(ws, w -> {pieces_sql('w')})))[0]"
    tokens, texts = "transform(docs, d -> flatten(transform(d, i -> x.s[i])))", f"transform(docs, d -> {bytes_sql('array_join(transform(d, i -> x.t[i]), {})'.format(repr('')))})"
    put = f"transform(array({folded}), x -> arrays_zip(ids, {tokens}, {texts}))[0]"
    found = chunks.crossJoin(F.broadcast(literals)).select(F.explode(F.expr(put)).alias("r"))
    r = F.col("r")
    return found.select(r.getField("ids").alias("doc_id"), r.getField("1").alias("tokens"), F.expr("if(r.`1` is null, null, size(r.`1`))").alias("n_tokens"), r.getField("2").cast("string").alias("decoded"))


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ``doc_id`` and ``tokens``."""
    literals, _ = _literals(tokens.sparkSession, path)
    one = tokens.select("doc_id", "tokens").crossJoin(F.broadcast(literals))
    return one.select("doc_id", F.expr(bytes_sql(pieces_sql("tokens"))).cast("string").alias("text"))
