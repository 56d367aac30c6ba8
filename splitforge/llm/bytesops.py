"""Vectorised byte helpers for Arrow text columns.

Tasks that must look at every byte receive Arrow batches and work on the raw
UTF-8 buffers with numpy, a few megabytes at a time, so memory is bounded by
the chunk size (or by one text, if a single text is longer than a chunk).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base % 2**64
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have, step = have + take, step * step % 2**64
    return out


class Hasher:
    """Polynomial hashes modulo 2**64 of any span of a byte buffer, O(1) each."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(buf):
            n = max(CHUNK, len(buf)) + 1
            self.up, self.down = powers(_BASE, n), powers(_INV, n)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * self.up[: len(buf)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of buf[start:end]; equal bytes give equal values."""
        h = (prefix[end] - prefix[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text each, with their bytes and offsets."""
    for batch in batches:
        buf, at = buffers(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of word bytes; runs never cross documents."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def table(chars: bytes | range | list, inverted: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return ~out if inverted else out


#: Bytes of the words between white space, and of lower-cased alphanumeric words (any non-ASCII byte belongs to a word).
NOT_SPACE = table([0x20, *range(0x09, 0x0E)], inverted=True)
ALNUM = table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
