"""Small helpers over Arrow batches: byte views, slices of bounded size, words and word hashes.

Every operator that leaves the JVM does so through ``mapInArrow``; these helpers
give its tasks numpy views of the text bytes. Work is done on slices of a few
megabytes, so a task's memory does not depend on the batch size (one document
is never split by them, so it is bounded by the longest document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20


def utf8_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; NULL counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``limit`` bytes each, one row at least."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, text: str = "text", within: str | None = None
                ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For each bounded slice of rows: the rows, their text bytes, and offsets from 0. ``within`` names a struct column that holds the text."""
    for rb in batches:
        col = rb.column(rb.schema.get_field_index(within or text))
        data, off = utf8_view(col.field(text) if within else col)
        for lo, hi in slices(off, limit):
            yield rb.slice(lo, hi - lo), data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    return data + (up.astype(np.uint8) << 5)


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each document, and each document's first word (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    sep = np.empty(n + 1, bool)
    sep[:n] = (data == 32) | ((data >= 9) & (data <= 13))
    sep[n] = True
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    inside = ~sep[:n]
    first = inside.copy()
    first[1:] &= sep[:n - 1] | edge[1:n]
    last = inside & (sep[1:] | edge[1:])
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_RNG = np.random.RandomState(20240110)
BYTE_CODES = _RNG.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _POWERS[base] = np.multiply.accumulate(have)
        have = _POWERS[base]
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher (murmur's constants) on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the slice.

    Equal spans get equal values wherever they lie; different spans may collide,
    so callers that need exactness compare the bytes of what matched.
    """
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * _powers(_P, n), out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * _powers(_PINV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + lens[i]."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total, dtype=np.int64)


def binary(data: np.ndarray, ends: np.ndarray, kind=pa.binary()) -> pa.Array:
    """A binary (or string) array over one run of bytes, cut at ``ends``."""
    offs = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])
