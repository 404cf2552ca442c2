"""Vectorised word and shingle hashing over Arrow string columns.

Everything here works on the UTF-8 bytes of a whole slice of rows at once, so that a task pays numpy prices for
each byte and Python prices only for each slice. Slices are bounded in bytes, which bounds the memory of a task
however long single texts are (one text longer than the bound forms a slice of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
#: By name, how a worker lets go of what it keeps from task to task.
KEPT: dict[str, Callable[[], None]] = {}

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits; bytes of other scripts count as letters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[48:58] = PUNCTUATION[65:91] = PUNCTUATION[97:123] = PUNCTUATION[128:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-xorshift rounds)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def spare() -> None:
    """Gives memory that is free in this process back to the system; what is in use stays."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most `limit` bytes of `column` each (one row at least).

    A worker lives on after a task, so what tasks of another operator have left in KEPT goes first, all but `keep`.
    """
    for name in KEPT.keys() - {keep}:
        KEPT[name]()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and the n+1 offsets of the texts; a null is an empty text."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, filled.offset * 8)
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a slice: byte ranges, 64-bit hashes and, for each text, the range of its words."""

    def __init__(self, column: pa.Array, breaks: np.ndarray = SPACES, lower: bool = True, prefixes: tuple[int, ...] = ()):
        data, offsets = utf8(column)
        self.data, self.offsets, n = data, offsets, len(data)
        inside = ~breaks[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        length = self.ends - self.starts
        first = np.cumsum(length) - length
        letters = data[inside]
        if lower:
            letters = _LOWER[letters]
        place = np.arange(len(letters)) - np.repeat(first, length)
        value = _BYTE[letters] * _PLACE[place & 4095]
        if len(length):
            self.hashes = mix(np.add.reduceat(value, first) + length.astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)
        self.prefixes = {}
        if prefixes:
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            for k in prefixes:
                long = np.flatnonzero(length > k)
                self.prefixes[k] = long, mix(run[first[long] + k] - run[first[long]] + _U(k * 1000003))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside one text, the word where each begins, and each text's range of them."""
        h, count = self.hashes, len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(self.bounds), np.int64)
        g = h[:count] * _STEP[0]
        for k in range(1, n):
            g += h[k : k + count] * _STEP[k]
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))[:count]
        at = np.flatnonzero(np.arange(count) + n <= last)
        return mix(g[at]), at, np.searchsorted(at, self.bounds)

    def whole(self, i: int) -> int:
        """A hash of the whole word sequence of text i."""
        h = self.hashes[self.bounds[i] : self.bounds[i + 1]]
        return int(mix(np.array([np.sum(mix(h + np.arange(1, len(h) + 1, dtype=np.uint64) * _STEP[1]), dtype=np.uint64)], np.uint64))[0])


def masked(h: np.ndarray, places: tuple[int, ...], count: int) -> np.ndarray:
    """For each of `count` beginnings, a hash of the words at `places` behind it; all other words are ignored."""
    g = np.zeros(count, np.uint64)
    for k, p in enumerate(places):
        g += h[p : p + count] * _STEP[k]
    return mix(g + _U(len(places)))
