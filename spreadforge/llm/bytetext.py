"""Texts as flat byte arrays: vectorised helpers used inside Arrow tasks.

All functions work on one bounded chunk of whole texts (``chunks``), so a task
holds a few arrays of the chunk's size and nothing that grows with its
partition."""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_U = np.uint64


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column (null: empty) into runs of whole texts of about
    ``limit`` bytes; a longer text is a run of its own.  Yields ``(first, end,
    bytes, offsets)``, offsets counted within the run."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[off[first]:off[end]], off[first:end + 1] - off[first]
        first = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross a text's end: ``(start,
    end, text)``."""
    n = len(mask)
    if n == 0:
        return (np.empty(0, np.int64),) * 3
    head = np.zeros(n + 1, bool)
    head[offsets[:-1]] = True
    head = head[:n]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = mask[:-1]
    start = np.flatnonzero(mask & (~prev | head))
    follows = np.empty(n, bool)
    follows[-1] = False
    follows[:-1] = mask[1:] & ~head[1:]
    end = np.flatnonzero(mask & ~follows) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return start, end, text


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` or more of them, kept between chunks up to
    twice the usual chunk."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(n, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * CHUNK_BYTES:
            _POWERS[base] = have
    return have


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hash of each byte range, by prefix sums of a polynomial modulo
    2**64 over mixed byte values."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * _U(base))
    size = 1 << max(10, int(len(data)).bit_length())
    p = _powers(size, base | 1)
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * p[:len(data)], out=pre[1:])
    inv = _powers(size, pow(base | 1, -1, 1 << 64))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.large_binary()).cast(pa.binary())


def group_slices(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array, plus its length."""
    if len(values) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def sequence_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of each range of a sequence of 64-bit values."""
    size = 1 << max(10, int(len(values)).bit_length())
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values * _U(base | 1)) * _powers(size, base | 1)[:len(values)], out=pre[1:])
    inv = _powers(size, pow(base | 1, -1, 1 << 64))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum, maximum) over every full window of ``width`` values."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = op(x[:-(width - have)], x[width - have:])
    return x


def first_smallest(key: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value of every full window of ``width``
    values."""
    low, at = key, np.arange(len(key), dtype=np.int32)
    have = 1
    while have < width and len(low):
        step = min(have, width - have)
        later = low[step:] < low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        have += step
    return at


def minimizers(key: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the first smallest of some window of ``width``
    positions.  Equal windows choose equal positions, and every window has
    one, so equal stretches of two texts share their choice."""
    low = sliding(key, width, np.minimum)
    if len(low) == 0:
        return np.empty(0, np.int64)
    n = len(low)
    pad = np.zeros(width - 1, np.uint64)
    high = sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    cand = np.flatnonzero(high[:len(key)] == key)
    # a candidate counts if no equal value stands before it in some window that it is smallest of
    value = key[cand]
    prev = np.full(len(cand), -1, np.int64)                    # the nearest earlier position of the same value
    by = np.lexsort((cand, value))
    same = value[by][1:] == value[by][:-1]
    prev[by[1:][same]] = cand[by[:-1][same]]
    first = np.maximum(np.maximum(prev + 1, cand - width + 1), 0)   # windows starting here or later see it first
    stop = np.minimum(cand, n - 1)
    ok = first <= stop
    cand, first, stop, value = cand[ok], first[ok], stop[ok], value[ok]
    # some window in first..stop has it as its smallest: the largest of their minima is its value
    hit = _range_max(low, first, stop) == value
    return cand[hit]


def _range_max(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Maximum of ``x[first..last]`` for many short ranges (sparse table)."""
    if len(first) == 0:
        return x[:0]
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.zeros(len(first), x.dtype)
    table, have = x, 0
    for k in range(int(level.max()) + 1):
        if k:
            table = np.maximum(table[:-(1 << (k - 1))], table[1 << (k - 1):])
        at = level == k
        if at.any():
            out[at] = np.maximum(table[first[at]], table[last[at] - (1 << k) + 1])
    return out
