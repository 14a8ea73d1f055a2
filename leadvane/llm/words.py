"""Words, hashes of word runs and content-selected positions of whole texts, computed on Arrow text buffers with numpy.

All functions work on a chunk: the UTF-8 bytes of neighbouring texts and the offsets at which each text begins. Hashes are
64 bits wide and depend on the content alone, so they agree between tasks.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 18
_P, _GOLD = 0x9E6C63D0876A9A47, U(0x9E3779B97F4A7C15)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(_P)), np.full(n, U(pow(_P, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair of bounds: a difference of prefix sums, so its cost is free of the length."""
    up, down = _powers(1 << max(12, len(values).bit_length()))
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * _GOLD)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of about ``size`` bytes; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def split(data: np.ndarray, off: np.ndarray, parting: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of every word, and the index of each text's first word (one more at the end)."""
    word = ~parting[data]
    border = np.zeros(len(data) + 1, bool)
    border[off] = True
    start, end = word.copy(), word.copy()
    if len(data):
        start[1:] &= ~word[:-1] | border[1:-1]
        end[:-1] &= ~word[1:] | border[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every word ``data[start:end]``: its bytes in lanes of eight, each mixed into the last state.

    Mixing has an inverse, so words of at most eight bytes and one length never share a hash. Unlike a sum of powers no
    pattern of letters cancels out in longer ones.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = (end - start).astype(np.int64)
    h, todo, at = mix(left.astype(U)), np.arange(len(start)), start
    while len(todo):
        lane = lanes[at].astype(U)
        short = left < 8
        lane[short] &= (U(1) << (left[short] * 8).astype(U)) - U(1)
        h[todo] = mix(h[todo] ^ lane)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def windows(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each run of ``k`` words within one text, and the text's number in the chunk."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(words))
    inside = at + k <= first[1:][text]
    return at[inside], text[inside]


def selected(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each ``i``, the position of the smallest of ``hashes[i:i + width]``, the leftmost among equals.

    Depends on the hashes alone (their upper 40 bits), so equal word runs select equal places.
    """
    low, pos = hashes >> U(24), np.arange(len(hashes))
    have, n = 1, len(hashes)
    while have < width:
        step = min(have, width - have)
        m = max(n - have - step + 1, 0)
        later = low[step:step + m] < low[:m]
        low, pos = np.where(later, low[step:step + m], low[:m]), np.where(later, pos[step:step + m], pos[:m])
        have += step
    return pos


def binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    off = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(rows.tobytes())])


def ragged_binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binary values ``values[first[i]:first[i + 1]]``."""
    values = np.ascontiguousarray(values)
    off = ((first - first[0]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(off), pa.py_buffer(values[first[0]:first[-1]].tobytes())])


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))
