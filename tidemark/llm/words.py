"""Vectorised word splitting and hashing over Arrow string buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Those bytes
never occur inside a multi-byte UTF-8 sequence, so byte and code-point splitting
agree.  Hashes are Rabin-Karp polynomials modulo 2**64 read off prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd bases of the two polynomials (fixed values).
BASE_BYTE, BASE_WORD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (xor-shift-multiply finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def separators() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


SEPARATOR = separators()


@lru_cache(maxsize=2)
def byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += U(32)
    return mix64((codes + U(1)) * BASE_WORD)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below at least n."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(key, -1, 1 << 64)
        tables = []
        for b in (key, inverse):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[key] = tuple(tables)
    return _powers[key]


def run_hashes(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, independent of where the run lies."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes each; a longer text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + target, "right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, words before each text and in all) of the texts data[offsets[i]:offsets[i+1]].

    ``offsets`` begins at 0 and the byte positions are relative to ``data``.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
    begins[edges] |= inside[edges]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    last = edges[1:] - 1
    finishes[last] |= inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    hashes = run_hashes(byte_values(lower)[data], BASE_BYTE, starts, ends)
    hashes = mix64(hashes ^ ((ends - starts).astype(np.uint64) * BASE_WORD))
    return hashes, starts, ends, np.searchsorted(starts, offsets)
