"""Word and shingle hashes of an Arrow column of texts, computed for all its bytes at once.

A word's hash is a polynomial over a fixed random table of byte values, finished by a mixing step, so it is the same in every task. Word lists come as flat
arrays: one 64-bit hash and one row number per word, in text order. Columns are cut into slices of a few megabytes, so that memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 3 << 20
#: Slices of the steps that follow each other in one session: arrays and power tables take some 50 times the slice, and a worker keeps that memory for later steps.
SMALL_SLICE = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all of them."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _table(separators: np.ndarray) -> np.ndarray:
    """Random value of each byte, the same for both cases of A-Z; 0 for separators."""
    t = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0xA0761D6478BD642F))
    t[65:91] = t[97:123]
    t[separators] = 0
    return t


_SPACES = np.array([32, *range(9, 14)])
#: Words between white space; words of letters and digits (bytes above 127 count as letters).
BY_SPACE = _table(_SPACES)
BY_LETTERS = _table(np.array([b for b in range(128) if not chr(b).isalnum()]))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_P, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p & (2**64 - 1), np.uint64)])) for p in (_P, inverse)]
    return _powers


class Words(NamedTuple):
    """``hash``, ``row`` and first byte (in ``data``) of each word; ``offsets`` of the rows in ``data``; ``first``: row of the column the slice begins at."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    first: int


def _hashed(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, first: int, most: int) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, data, offsets, first)
    values = table[data]
    apart = values == 0
    begins = ~apart
    begins[1:] &= apart[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = ~apart[heads]
    start = np.flatnonzero(begins)
    if not len(start):
        return Words(np.zeros(0, np.uint64), start, start, data, offsets, first)
    up, down = _power_tables(max(n, most))
    values *= up[:n]
    h = mix(np.add.reduceat(values, start) * down[start])
    return Words(h, np.searchsorted(offsets, start, "right") - 1, start, data, offsets, first)


def slices(column: pa.Array, table: np.ndarray = BY_SPACE, most: int | None = None) -> Iterator[Words]:
    """The words of the column's texts (null: none), slice by slice of whole rows: of up to ``most`` bytes (SLICE_BYTES unless given), or of one longer text."""
    most = most or SLICE_BYTES
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    if not len(column):
        return
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield _hashed(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], table, a, most)
        a = b


def shingles(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of ``n`` words within a row."""
    if len(h) < n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    out = np.zeros(len(h) - n + 1, np.uint64)
    factor = 1
    for j in range(n):
        factor = factor * 0xC2B2AE3D27D4EB4F % (1 << 64)
        out += h[j:len(h) - n + 1 + j] * np.uint64(factor)
    at = np.flatnonzero(row[:len(out)] == row[n - 1:])
    return mix(out[at]), row[at], at
