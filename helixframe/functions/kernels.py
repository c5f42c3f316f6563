"""NumPy kernels over Arrow string columns: runs of letters as numbers, sorted sets, hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Records worked on at a time, so that the arrays stay in the processor's cache.
STEP = 500


def steps(b: pa.RecordBatch):
    for i in range(0, b.num_rows, STEP):
        yield b.slice(i, STEP)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit numbers that spreads them evenly."""
    x = x.astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads them evenly."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string array without nulls."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def codes(off: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Base-26 codes of all runs of k letters and the record each belongs to, in text order. Letters are A-Z."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = data.astype(np.int64) - 65
    code = np.zeros(n, np.int64)
    for j in range(k):
        code = code * 26 + a[j : j + n]
    rec = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    inside = np.arange(n) + k <= off[rec + 1]
    return rec[inside], code[inside]


def byte_runs(off: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Record and 64-bit hash of all runs of k bytes of any text, in text order."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(1_000_003) + data[j : j + n]
    rec = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    inside = np.arange(n) + k <= off[rec + 1]
    return rec[inside], mix64(h[inside])


def first_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Positions at which a sorted array changes, 0 included."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is several times faster here than hashing."""
    x = np.sort(x)
    return x[first_of(x)]


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order: a, b, times met."""
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], np.diff(np.r_[at, len(a)])
