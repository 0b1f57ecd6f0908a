"""Columns of numbers as compressed bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers: how many, then all first bytes together, all second ones, and
    so on, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + (pa.compress(planes.data, codec="zstd", asbytes=True) if len(x) else b"")


def unpack(data: bytes, dtype: type = np.uint64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    planes = pa.decompress(memoryview(data)[8:], 8 * n, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers, as steps."""
    step = x.copy()
    step[1:] -= x[:-1]
    return pack(step)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the range of 64-bit keys that a key falls into."""
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cuts(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending keys, and the end of the last."""
    return np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
