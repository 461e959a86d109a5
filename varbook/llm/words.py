"""Whole-batch word kernels over Arrow string columns.

A word is a maximal run of bytes above 0x20; ASCII letters are folded to lower
case.  A null text counts as an empty one.  Each kernel takes a run of texts as
one byte array, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_BYTES[65:91] = _BYTES[97:123]
_powers: dict[int, np.ndarray] = {}
ALL = U64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if len(have) <= 1 << 21:
            _powers[base] = have
    return have[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], alike wherever the same run stands."""
    n = len(values)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(values * powers(_BASE, n), dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.string():
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): whole texts, about size bytes at a time."""
    data, offsets = raw(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each text's bounds in the list of words."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.greater(data, 32, out=inside[1:-1])
    before, after = inside[:-2].copy(), inside[2:].copy()
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    body = inside[1:-1]
    starts, ends = np.flatnonzero(body & ~before), np.flatnonzero(body & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and each text's bounds in them."""
    starts, ends, bounds = spans(data, offsets)
    return run_hashes(_BYTES[data], starts, ends) if len(starts) else np.zeros(0, U64), bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
