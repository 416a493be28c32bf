"""Vectorised tokenisation of Arrow text batches.

A token is a maximal run of ASCII letters, digits, underscores and bytes above 0x7F, after simple lower-casing,
which keeps the number of code points. Null texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES // 4 + 1)
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = _BASE, _INVERSE
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n > 4 * CHUNK_BYTES:
            return up[:n], down[:n]
        _POWERS.update(up=up, down=down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls, and the offsets of its rows."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, off - off[0]


@dataclass
class Words:
    """Tokens of some rows: byte spans, hashes and the offsets of each row's tokens."""

    data: np.ndarray
    row_bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, whatever its place; spans are ascending and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + CHUNK_BYTES, "right")))
        lo, hi = int(starts[k]), int(ends[stop - 1])
        up, down = _powers(hi - lo + 1)
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        s, e = starts[k:stop] - lo, ends[k:stop] - lo
        out[k:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        k = stop
    return out


def equal_spans(a: np.ndarray, begin: np.ndarray, b: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of two byte arrays, ``size`` bytes from two places each, hold the same bytes."""
    edge = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(edge[-1])
    wrong = np.concatenate([[0], np.cumsum(a[np.repeat(begin - edge[:-1], size) + step] != b[np.repeat(other - edge[:-1], size) + step])])
    return wrong[edge[1:]] == wrong[edge[:-1]]


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different byte spans: their hashes and first places among the spans, and for each span which of them it is.

    Hashes only bring equal spans together; bytes decide, and where spans of one hash differ, bytes alone.
    """
    hashes, size = span_hashes(data, starts, ends), ends - starts
    h, at, place = np.unique(hashes, return_index=True, return_inverse=True)
    same = size == size[at][place]
    if same.all() and equal_spans(data, starts, data, starts[at][place], size).all():
        return h, at, place
    seen: dict[bytes, int] = {}
    place = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(starts, ends)])
    at = np.unique(place, return_index=True)[1]
    return hashes[at], at, place


def words(arr: pa.Array, lower: bool = True) -> Words:
    """Tokens of a text array; nulls are taken as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if lower:
        arr = pc.utf8_lower(arr)
    data, off = text_bytes(arr)
    n = len(data)
    inside = WORD_BYTE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, off, starts, ends, np.searchsorted(starts, off), span_hashes(data, starts, ends))


def code_points_before(data: np.ndarray) -> np.ndarray:
    """For each byte place, the number of code points that begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts take about ``limit`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            base = int(total[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
