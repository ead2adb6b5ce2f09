"""Array kernels over UTF-8 text columns, used inside Spark tasks.

Words here are maximal runs of bytes other than the six ASCII white-space bytes (0x20, 0x09-0x0D);
A-Z count as a-z. All functions take the raw buffers of an Arrow string column, so nothing is
turned into Python strings.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Ranges up to this length are hashed by arrays, eight bytes at a time; longer ones, few in any text, one by one.
ARRAY_BYTES = 64
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def code_points(padded: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points of the characters of two to four bytes whose first bytes are at lead; padded ends in three more bytes."""
    a, b, c, d = (padded[lead + k].astype(np.int32) for k in range(4))
    two = (a & 0x1F) << 6 | b & 0x3F
    three = (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F
    four = (a & 0x07) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F
    return np.minimum(np.where(a < 0xE0, two, np.where(a < 0xF0, three, four)), 0x10FFFF)


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges of rows of about limit bytes each, one row at least; every row is in exactly one."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the range of its words."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = np.empty(n + 1, bool)
    first[0] = False
    first[n] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first[1:n] = inside[1:] & (~inside[:-1] | edge[1:n])
    first[0] = inside[0]
    last = np.empty(n, bool)
    last[:-1] = inside[:-1] & (~inside[1:] | edge[1:n])
    last[-1] = inside[-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def step(state: np.ndarray, value: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Take 64 more bits into running hashes: one to one in each of both, and in the order of the values."""
    x = (state ^ value) * factor
    return x ^ (x >> np.uint64(32))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of ranges of bytes; with two, second ones too, so that both together have 128 bits.

    Multiplications and shifts alternate, so texts of a regular build do not collide as they do for polynomials.
    Ranges of one length of up to eight bytes never collide.
    """
    n = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    factors = (FIRST, SECOND)[: 1 + two]
    size = np.minimum(n, ARRAY_BYTES + 1).astype(np.uint64)
    out = [mix(size * f + f) for f in factors]
    live: np.ndarray | slice = slice(None)
    for k in range(0, ARRAY_BYTES, 8):
        if k:
            live = np.flatnonzero((n > k) & (n <= ARRAY_BYTES)) if k == 8 else live[n[live] > k]
            if not len(live):
                break
        left = n[live] - k
        chunk = eight[np.minimum(starts[live] + k, len(data))] & _KEEP[np.clip(left, 0, 8)]
        for h, f in zip(out, factors, strict=True):
            h[live] = step(h[live], chunk, f)
    long = np.flatnonzero(n > ARRAY_BYTES)
    for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        raw = data[a:b].tobytes()
        for j, h in enumerate(out):
            h[i] = xxhash.xxh3_64_intdigest(raw, seed=j)
    return tuple(mix(h) for h in out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    return byte_hashes(LOWER[data] if lower else data, starts, ends)[0]


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word window inside its row, and the row of each. A shorter row gives its whole sequence as one."""
    n = len(words)
    counts = np.diff(bounds)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    per_row = np.maximum(counts - k + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), per_row)
    first = np.cumsum(per_row) - per_row
    starts = np.arange(len(rows)) - first[rows] + bounds[:-1][rows]
    size = np.minimum(counts, k)[rows]
    out = mix(size.astype(np.uint64) + FIRST)
    for j in range(k):
        more = step(out, words[np.minimum(starts + j, n - 1)], FIRST)
        out = np.where(size > j, more, out) if (size <= j).any() else more
    return mix(out), rows


def unique_in_rows(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the row bounds."""
    if len(values) == 0:
        return values, np.zeros(n_rows + 1, np.int64)
    out, counts = [], np.zeros(n_rows, np.int64)
    cuts = np.searchsorted(rows, np.arange(n_rows + 1))
    for i in range(n_rows):
        if cuts[i + 1] > cuts[i]:
            v = np.sort(values[cuts[i] : cuts[i + 1]])
            if len(v) > 1:
                keep = np.empty(len(v), bool)
                keep[0] = True
                np.not_equal(v[1:], v[:-1], out=keep[1:])
                v = v[keep]
            counts[i] = len(v)
            out.append(v)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])


def lean(run: Callable) -> Callable:
    """run, a function over batches, with memory that earlier tasks of the worker held given back before and after it.

    Workers live on between tasks; without this, the free memory of each adds to an executor's size.
    """

    def trimmed(*args: object) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)
        yield from run(*args)
        if trim:
            trim(0)

    def grouped(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from trimmed(key, batches)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from trimmed(batches)

    # Spark tells the forms of grouped functions apart by their hints
    return grouped if run.__code__.co_argcount == 2 else mapped
