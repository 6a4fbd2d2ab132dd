"""Words of many texts at once, as numpy arrays over UTF-8 bytes.

All word definitions used here are sets of bytes, and no byte of a multi-byte character is a
separator, so splitting bytes equals splitting characters. Words are known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer single text is handled whole.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_P, _P_INV = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

#: White-space bytes that end a word in most operators.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, all else unchanged.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Chunk(NamedTuple):
    """Some rows of a batch: ``data[offsets[i]:offsets[i + 1]]`` is the text of row ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Start and end bytes and hashes of all words; row i has words ``rows[i]:rows[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64. Those that a chunk needs are
    kept; more, for a text longer than a chunk, are made for the one call."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    out = []
    for base in (_P, _P_INV):
        step = np.full(max(n, 1 << 16), base, _U)
        step[0] = 1
        out.append(np.cumprod(step, dtype=_U))
    if n <= 2 * CHUNK_BYTES:
        _POWERS[:] = out
    return out[0][:n], out[1][:n]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a string column (null: empty), ``limit`` bytes or one text at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Chunk(first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(chunk: Chunk, separator: np.ndarray = SPACE, lower: bool = False) -> Words:
    """All words of a chunk: runs of bytes that are no separators, within one row."""
    data = LOWER[chunk.data] if lower else chunk.data
    inside = ~separator[data]
    n = len(data)
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
    begin[edges] = inside[edges]
    last = edges[1:] - 1
    stop[last] = inside[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h += (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)
    return Words(start, end, mix(h), np.searchsorted(start, chunk.offsets))


def grams(w: Words, k: int) -> np.ndarray:
    """Hash of each k consecutive words from each word on; those that cross a row's end mean nothing."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, _U)
    if k <= 8:
        out = np.zeros(n - k + 1, _U)
        for i in range(k):
            out = (out + w.hash[i : n - k + 1 + i]) * _P
        return mix(out)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(w.hash * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def batches(it: Iterator[pa.RecordBatch], limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of about ``limit`` bytes at most, at least a row each."""
    for b in it:
        step = max(1, int(b.num_rows * limit // max(b.nbytes, limit)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
