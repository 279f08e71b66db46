"""Vectorised text kernels used inside Arrow tasks.

Spark hands each task Arrow batches; these helpers turn one string column into flat
numpy arrays (word bounds, 64-bit word hashes, owning row) without a Python loop over
words.  A word is a maximal run of ``[^\\x20\\x09-\\x0D]``; as every separator is one
ASCII byte, the work is done on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}
_KEPT: dict[str, Any] = {}

#: Bytes of text and rows that are handled at a time; they bound the arrays of a task.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 1 << 13
#: Bits of a hash that are kept beside the row of a slice in one 64-bit number.
TOKEN_BITS = 50


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "up" not in _POW or len(_POW["up"]) < n:
        size = max(n, SLICE_BYTES + 64)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            powers = np.full(size, base, dtype=np.uint64)
            powers[0] = 1
            _POW[name] = np.cumprod(powers, dtype=np.uint64)
    return _POW["up"][:n], _POW["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string array; nulls must be of length 0."""
    n = len(column)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=wide)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in the Python worker for its later tasks."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Lets go of what tasks of other stages kept: Python workers outlive stages."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) pieces of about ``most`` bytes, nulls as empty strings; a longer row is a piece of its own."""
    _, offsets = raw(column)
    at, n = 0, len(column)
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1), at + SLICE_ROWS)
        yield at, column.slice(at, to - at).fill_null("")
        at = to


class Words:
    """Words of a slice of rows: byte bounds, hash and owning row of each, in order.

    With ``letters``, words are runs of ASCII letters and of bytes beyond ASCII instead.
    """

    __slots__ = ("bytes", "count", "end", "first", "hash", "offsets", "row", "start")

    def __init__(self, column: pa.Array, lower: bool = False, letters: bool = False):
        data, offsets = raw(column)
        if lower and len(data):
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.bytes, self.offsets = data, offsets
        n = len(data)
        inside = np.ones(n + 1, dtype=bool)
        if letters:
            inside[:n] = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
        else:
            inside[:n] = (data > 32) | (data < 9) | ((data > 13) & (data < 32))
        inside[n] = False
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < n]
        begins[edges] |= inside[edges]
        self.start = np.flatnonzero(begins)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = edges[edges > 0] - 1
        last[cuts] |= inside[cuts]
        self.end = np.flatnonzero(last[:n]) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each row, and the total
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = word_hashes(data, self.start, self.end)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair, by differences of one running sum."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def window_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of k words; a row with 1 to k-1 words gives one window of all."""
    h, n = words.hash, len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = np.uint64(0x9FB21C651E98DF25)
    full = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for i in range(k):
        full = full * c + h[i : n - k + 1 + i]
    inside = words.row[: n - k + 1] == words.row[k - 1 :] if n >= k else np.zeros(0, bool)
    rows, hashes = words.row[: max(0, n - k + 1)][inside], mix(full[inside])
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        extra = []
        for r in short:
            x = 0
            for v in h[words.first[r] : words.first[r + 1]].tolist():
                x = (x * int(c) + v + 0x5851) & 0xFFFFFFFFFFFFFFFF
            extra.append(x)
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, mix(np.array(extra, dtype=np.uint64))])
    return rows, hashes


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, token) pairs of a slice, ordered by row, then token; a token is the top
    ``TOKEN_BITS`` bits of a hash."""
    packed = (rows.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (hashes >> np.uint64(64 - TOKEN_BITS))
    packed.sort()
    keep = np.ones(len(packed), dtype=bool)
    keep[1:] = packed[1:] != packed[:-1]
    packed = packed[keep]
    return (packed >> np.uint64(TOKEN_BITS)).astype(np.int64), packed & np.uint64((1 << TOKEN_BITS) - 1)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums (modulo 2**64) of consecutive segments of the given lengths."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]
