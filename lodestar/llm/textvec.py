"""Vectorised text kernels on numpy arrays: every helper works on a bounded chunk of concatenated texts.

Python operators receive Arrow batches.  A batch is cut into chunks of about ``CHUNK_BYTES`` bytes (one text at least), so working
memory is bounded by the chunk or by the largest single text, not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}
_caches: list[tuple[str, Callable[[], object]]] = []
_user = [""]


def _powers(base: int, n: int, key: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept and doubled when a longer text comes)."""
    have = _pow.get(key)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_BYTES)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size > 4 * CHUNK_BYTES:  # powers for a giant text are not kept
            return out
        _pow[key] = have = out
    return have[:n]


def powers(n: int) -> np.ndarray:
    """The first n powers of the polynomial hashes' base."""
    return _powers(_MULT, n, "p")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_table(size: int, seed: int = 7) -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each unit (byte or code point)."""
    return mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_MULT) + np.uint64(seed))


BYTE_UNIT = unit_table(256)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of the first i 64-bit values; spans follow from :func:`span_hash`."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * _powers(_MULT, len(values), "p"), out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hashes of the spans [start, end)."""
    return mix((h[end] - h[start]) * _powers(_INV, len(h), "i")[start])


def symbol_hash(symbols: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """:func:`prefix_hash` of unit[symbols], block by block: nothing but the result is as long as the text."""
    out = np.empty(len(symbols) + 1, np.uint64)
    out[0] = carry = np.uint64(0)
    for a in range(0, len(symbols), CHUNK_BYTES):
        part = unit[symbols[a : a + CHUNK_BYTES]]
        part *= _powers(_MULT, len(part), "p")
        part *= np.uint64(pow(_MULT, a, 1 << 64))
        np.cumsum(part, out=part)
        part += carry
        out[a + 1 : a + 1 + len(part)] = part
        carry = part[-1]
    return out


def power_at(pos: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The base (or its inverse) to the given powers, from two short tables."""
    low = _powers(_INV if inverse else _MULT, 1 << 16, "i" if inverse else "p")
    high = int(pos.max()) >> 16 if len(pos) else 0
    step = pow(_INV if inverse else _MULT, 1 << 16, 1 << 64)
    table = np.array([pow(step, k, 1 << 64) for k in range(high + 1)], np.uint64)
    return low[pos & 0xFFFF] * table[pos >> 16]


def long_span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """:func:`span_hash` without a table as long as the text."""
    return mix((h[end] - h[start]) * power_at(start, inverse=True))


def rolling_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams."""
    n = len(h) - 1 - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((h[k:] - h[: n]) * _powers(_INV, n, "i"))


def binary(col: pa.Array) -> pa.Array:
    """A string column's UTF-8 bytes as large_binary; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    col = col.cast(pa.large_binary())
    return col.fill_null(b"") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary array without nulls; offsets start at 0."""
    buf = col.buffers()
    off = np.frombuffer(buf[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buf[2], np.uint8)[off[0] : off[-1]] if buf[2] is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for chunks of about ``limit`` bytes of a large_binary column."""
    n = len(col)
    if not n:
        return
    data, off = raw(col)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def row_of(offsets: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The row in which each position lies (empty rows are skipped)."""
    return np.searchsorted(offsets, pos, "right") - 1


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a row border."""
    n = len(mask)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | border[1:n]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | border[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the given ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    out = np.ones(total, np.int64)
    ends = np.cumsum(lengths)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes (broken bytes become U+FFFD)."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row, as int64."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)


def trim() -> None:
    """Give freed memory back to the system: a worker keeps its process from task to task, and large arrays leave holes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def cached(user: str, clear: Callable[[], object]) -> None:
    """Name the operator that a module's cache in the worker belongs to."""
    _caches.append((user, clear))


def trimmed(batches: Iterator[pa.RecordBatch], user: str = "") -> Iterator[pa.RecordBatch]:
    """The batches; memory that a batch's work has freed goes back before the next one.  A worker lives on from operator to operator: the caches
    of others than ``user`` are given up first."""
    if user != _user[0]:
        for name, clear in _caches:
            if name != user:
                clear()
        _user[0] = user
        trim()
    for b in batches:
        yield b
        trim()


class Memo:
    """A bounded map from 64-bit keys to rows of parallel arrays, kept in sorted numpy arrays (a worker's cache across batches)."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.where = np.empty(0, np.int64)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.where[at], -1)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """New rows for distinct absent keys; returns their numbers."""
        rows = np.arange(self.size, self.size + len(keys))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.where = np.insert(self.where, at, rows[order])
        self.size += len(keys)
        return rows
