"""Words of UTF-8 texts as 64-bit hashes, a whole Arrow batch at a time.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 is the pattern
``[^\\x20\\x09-\\x0D]+``. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one go; a longer text is handled alone.
SLICE_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def releasing(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's generator that, once done, gives freed memory back to the machine: Python workers outlive their tasks, and what
    their allocators keep would count against the executor in later stages."""

    @wraps(run)
    def task(*args) -> Iterator:
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not every C library has it
                pass

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, SLICE_BYTES // 4), base, np.uint64)
            steps[0] = 1
            _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


@dataclass
class Words:
    """Words of consecutive texts. first[d]:first[d+1] are those of text d; start and end are byte offsets in data."""

    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about SLICE_BYTES: (from row, to row, bytes, offsets from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def tokenize(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts data[offsets[d]:offsets[d+1]]; lower folds A-Z before hashing."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(_BASE, n), out=total[1:])
        words = mix((total[end] - total[start]) * _power(_INVERSE, n)[start] + (end - start).astype(np.uint64))
    return Words(data, offsets, words, start, end, np.searchsorted(start, offsets).astype(np.int64))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of `size` words within a text, and the index of its first word."""
    last = np.repeat(words.first[1:], words.count)
    at = np.flatnonzero(np.arange(len(words.hash)) + size <= last)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words.hash[at + k]
    return mix(out), at


def distinct(text_of: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each of n texts, ascending, and where those of each text begin (n + 1 offsets)."""
    order = np.lexsort((values, text_of))
    t, v = text_of[order], values[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    t, v = t[keep], v[keep]
    return v, np.searchsorted(t, np.arange(n + 1))


def lists(values: np.ndarray, begins: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values, kind))
