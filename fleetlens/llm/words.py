"""Words ``[^\\x20\\x09-\\x0D]+`` of Arrow text columns as numpy arrays, hashed without Python loops."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: SQL (Java) and DuckDB (RE2) pattern of one word
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    """Words of consecutive documents: byte ranges in ``data``, hashes, and each document's first word."""

    first: int  #: number of the first document in its batch
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offset: np.ndarray  #: documents + 1 word numbers

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist()))


def trimmed(run):
    """A task function that hands its worker's free memory back when the task ends.

    Workers live on between tasks, next to the executor's heap.
    """
    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        size = max(n, CHUNK_BYTES + 1)
        p = np.empty(size, np.uint64)
        p[0], have = 1, 1
        while have < size:
            step = min(have, size - have)
            p[have:have + step] = p[:step] * np.uint64(pow(base, have, 1 << 64))
            have += step
        if size <= 32 * CHUNK_BYTES:
            _powers[base] = p
    return p[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and value offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), off


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of whole documents, a cache-sized part at a time; a longer document is a chunk of its own."""
    data, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield _words(i, data[off[i]:off[j]], off[i:j + 1] - off[i], lower)
        i = j


def _words(first: int, data: np.ndarray, off: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    start, end = bounds(data, off)
    return Words(first, data, start, end, hashes(data, start, end), np.searchsorted(start, off))


def bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word; no word crosses the document offsets."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none
    word = _IS_WORD[data]
    full = off[:-1] < off[1:]
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    lead = off[:-1][full]
    edge[lead] = word[lead]
    start = np.flatnonzero(edge)
    edge = word.copy()
    edge[:-1] &= ~word[1:]
    last = off[1:][full] - 1
    edge[last] = word[last]
    return start, np.flatnonzero(edge) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_INVERSE, len(data) + 1)[start])


def grams(w: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and documents + 1 offsets into them.

    With ``short``, a document of 1 to k - 1 words has its whole sequence as one window.
    """
    n = np.diff(w.offset)
    count = np.maximum(n - k + 1, 0)
    base = _BASE * 5 + 2
    size = len(w.hash)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(w.hash * powers(base, size), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), size)
    at = np.arange(size)
    inside = at + k <= np.repeat(w.offset[1:], n)
    at = at[inside]
    h = mix(((total[at + k] - total[at]) * inverse[at]) ^ np.uint64(k))
    offset = np.concatenate([[0], np.cumsum(count)])
    if short and (few := (n > 0) & (n < k)).any():
        docs = np.flatnonzero(few)
        a, b = w.offset[docs], w.offset[docs + 1]
        whole = mix(((total[b] - total[a]) * inverse[a]) ^ (n[docs].astype(np.uint64)))
        h = np.insert(h, offset[docs], whole)
        offset = np.concatenate([[0], np.cumsum(count + few)])
    return h, offset
