"""Words of Arrow string columns as numpy arrays: bytes, bounds and 64-bit hashes, no per-row Python."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once in a task; a single longer text is handled whole.
SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1 + column.offset)
    return raw[column.offset :].astype(np.int64)


def byte_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(_offsets(column)) if len(column) else np.zeros(0, np.int64)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = _offsets(column)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


@dataclass
class Words:
    """start, end: byte bounds of each word; first[i]:first[i + 1] are the words of row i; code: 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(data: np.ndarray, off: np.ndarray, lower: bool = True, space: np.ndarray | None = None) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row, or runs of bytes that aren't in ``space``; A-Z lower-cased for the hash if ``lower``."""
    n = len(data)
    if not n:
        return Words(*(np.zeros(0, np.int64),) * 2, np.zeros(len(off), np.int64), np.zeros(0, np.uint64))
    space = SPACE[data] if space is None else space
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start, end = ~space, ~space
    start[1:] &= space[:-1] | cut[1:n]
    end[:-1] &= space[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    with np.errstate(over="ignore"):
        power = np.full(n, _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER[data] if lower else data).astype(np.uint64) * power + power, dtype=np.uint64, out=total[1:])
        inverse = np.full(n, _BASE_INV, np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse, dtype=np.uint64)
        code = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _STEP)
    return Words(s, e, np.searchsorted(s, off), code)


def shingles_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words that begin at each word, and which of these lie within one row."""
    n = len(words.code)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        m = n - k + 1
        for i in range(k):
            out[:m] = out[:m] * _BASE + words.code[i : i + m]
        out = mix(out)
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(n)
    return out, left >= k


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i] + 1, ... of ``length[i]`` items each, end to end."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.asarray(first, np.int64) - (np.cumsum(length) - length)
    return np.repeat(shift, length) + np.arange(total)
