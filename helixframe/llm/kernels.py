"""Kernels on windows of residues, and packed exchange of per-record results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from helixframe.functions.kernels import codes, first_of, mix32, mix64, steps, text_bytes, unique, unique_pairs

__all__ = ["codes", "first_of", "mix32", "mix64", "steps", "text_bytes", "unique", "unique_pairs"]

WINDOW = 5


def window_jaccard(a: str, b: str) -> float:
    """Common windows / windows in either; 0 when one has none."""
    wa, wb = {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)}, {b[i : i + WINDOW] for i in range(len(b) - WINDOW + 1)}
    if not wa or not wb:
        return 0.0
    both = len(wa & wb)
    return both / (len(wa) + len(wb) - both)


def pair_jaccards(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact window Jaccard of aligned sequences."""
    n = len(left)
    keys = []
    for col in (left, right):
        rec, code = codes(*text_bytes(col), WINDOW)
        keys.append(unique((rec << 24) | code))
    sizes = [np.bincount(k >> 24, minlength=n) for k in keys]
    both = np.sort(np.concatenate(keys))
    twice = both[1:][both[1:] == both[:-1]]
    common = np.bincount(twice >> 24, minlength=n)
    return common / np.maximum(sizes[0] + sizes[1] - common, 1)


PACKED = "bucket int, ids binary, payload binary"


def pack_buckets(bucket: np.ndarray, n_buckets: int, ids: np.ndarray, payload: np.ndarray, shift: int = 0) -> pa.RecordBatch:
    """One row for each bucket met: ids as offsets from their least (4 bytes where they fit), payload as raw records.

    Shuffling a few large binaries in place of many small rows keeps the exchange near the cost of a copy.
    """
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    starts = first_of(b)
    ends = np.r_[starts[1:], len(b)]
    rows_b, rows_i, rows_p = [], [], []
    for s, e in zip(starts.tolist(), ends.tolist()):
        part = order[s:e]
        own = ids[part]
        low = int(own.min())
        wide = int(own.max()) - low >= 1 << 32
        head = np.array([low, int(wide)], np.int64).tobytes()
        rows_b.append(int(b[s]) + shift)
        rows_i.append(head + ((own - low).astype(np.int64 if wide else np.uint32)).tobytes())
        rows_p.append(payload[part].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows_b, pa.int32()), pa.array(rows_i, pa.binary()), pa.array(rows_p, pa.binary())], ["bucket", "ids", "payload"])


def unpack_bucket(t: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids and payload records of all rows of a bucket."""
    ids, payload = [], []
    for i, p in zip(t.column("ids").to_pylist(), t.column("payload").to_pylist()):
        low, wide = np.frombuffer(i[:16], np.int64)
        ids.append(np.frombuffer(i[16:], np.int64 if wide else np.uint32).astype(np.int64) + low)
        payload.append(np.frombuffer(p, dtype))
    return (np.concatenate(ids), np.concatenate(payload)) if ids else (np.zeros(0, np.int64), np.zeros(0, dtype))


def pair_blocks(starts: np.ndarray, ends: np.ndarray, limit: int = 2_000_000):
    """Index pairs (i < j) inside each run [start, end), in blocks of about ``limit`` pairs; no run is cut short."""
    n = ends - starts
    keep = n > 1
    starts, n = starts[keep], n[keep]
    small = n <= 1024
    todo, size = [], 0
    order = np.flatnonzero(small)
    cost = n[order] * (n[order] - 1) // 2
    if len(order):
        block = np.cumsum(cost) // limit
        for c in np.unique(block):
            todo = order[block == c]
            s, m = starts[todo], n[todo]
            row = np.repeat(np.arange(len(todo)), m)
            i = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            reps = np.repeat(m, m) - 1 - i
            left = np.repeat(np.repeat(s, m) + i, reps)
            step = np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
            yield left, left + 1 + step
    for x in np.flatnonzero(~small).tolist():
        s, m = int(starts[x]), int(n[x])
        i = 0
        while i < m - 1:
            take = max(1, min(m - 1 - i, limit // (m - 1 - i)))
            rows = np.arange(i, i + take)
            reps = m - 1 - rows
            left = np.repeat(rows, reps)
            step = np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
            yield s + left, s + left + 1 + step
            i += take
