"""Words and shingles of many texts at once, as numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from stopflow.llm.tokens import forget

# Bytes of text that are turned into numbers at a time; one longer text goes alone.
SLICE_BYTES = 1 << 20

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.random.default_rng(20240501)
# a random odd number for every byte, and the base that tells places apart
_BYTE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_SEED.integers(0, 1 << 62)) * 2 + 1
_BASE_BACK = pow(_BASE, -1, 1 << 64)
_STEP = _SEED.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_BACK)):
            p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `limit` bytes of text, the bytes and the
    place of each text in them. A null text is empty."""
    forget()
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        if not len(texts):
            continue
        _, offsets, data = texts.buffers()
        places = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(places, places[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start), raw[places[start]:places[end]], places[start:end + 1] - places[start]
            start = end


def words(raw: np.ndarray, places: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) and
    the number of words before each text.

    A word's hash is a polynomial in its bytes, each replaced by a random odd
    number, and its length, modulo 2^64 and scrambled.
    """
    n = len(raw)
    gap = _GAP[raw]
    edge = np.zeros(n + 1, bool)
    edge[places] = True
    before = np.ones(n + 1, bool)
    before[1:] = gap
    starts = np.flatnonzero(~gap & (before[:n] | edge[:n]))
    after = np.ones(n, bool)
    if n:
        after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    forth, back = _powers(n + 1)
    value = _BYTE[_LOWER[raw] if lower else raw]
    value *= forth[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    h = (total[ends] - total[starts]) * back[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * _STEP[63])
    return h, starts, ends, np.searchsorted(starts, places)


def shingles(h: np.ndarray, firsts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For every text its distinct shingles of `size` words as sorted numbers; a
    text with fewer words is one shingle, one without words has none."""
    n = len(h)
    if n >= size:
        total = h[:n - size + 1] * _STEP[0]
        for k in range(1, size):
            total = total + h[k:n - size + 1 + k] * _STEP[k]
        total = mix(total)
    else:
        total = np.zeros(0, np.uint64)
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= size:
            s = np.sort(total[a:b - size + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            yield s
        elif b > a:
            part = h[a:b] * _STEP[:b - a]
            yield mix(part.sum(dtype=np.uint64, keepdims=True) + _STEP[40 + b - a])
        else:
            yield np.zeros(0, np.uint64)
