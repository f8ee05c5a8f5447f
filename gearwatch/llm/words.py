"""Words of whole texts as numpy arrays, a bounded slice of a batch at a time.

A word is a maximal run of characters other than space, tab, line feed, vertical
tab, form feed and carriage return. All of these are single bytes in UTF-8, so
words are found on bytes. A word's hash adds a random-looking value for each (byte, place)
and a run's hash joins the hashes of its halves; both mix without linear structure, so
texts made to defeat polynomials do not collide, and no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # text bytes worked on at once; one longer text is a slice of its own
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, and 5 modulo 8
_MASK = (1 << 64) - 1

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every input bit moves every output bit (xor-shift and multiply, invertible)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] = _LOWERED[97:123]
_PLACES = 256  # places of a word's bytes whose values are looked up
_AT_PLACE = mix(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * np.uint64(_BASE))
_BEYOND = np.uint64(0x2545F4914F6CDD1D)  # stands for a word behind a text's end
_HASH_BYTES = 1 << 18  # bytes hashed at once


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base & _MASK, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_kept_powers = lru_cache(maxsize=1)(_powers)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``size`` of each; those of a slice are kept, more are not."""
    return _kept_powers(SLICE_BYTES // 4) if size <= SLICE_BYTES // 4 else _powers(size)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` text bytes (at least one row)."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    through = np.cumsum(size + 1)
    low = 0
    while low < batch.num_rows:
        done = through[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(through, done + limit, "right")))
        yield batch.slice(low, high - low)
        low = high


class Words:
    """Spans of the words of some texts: byte ``start`` and ``end``, number of the ``text``."""

    def __init__(self, texts: pa.Array, separator: np.ndarray = SEPARATOR):
        self.data, self.offsets = utf8(texts)
        self.n_texts = len(self.offsets) - 1
        inside = np.zeros(len(self.data) + 2, dtype=bool)
        inside[1:-1] = ~separator[self.data]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edge = self.offsets[1:-1]  # a text's first byte begins a word, its last one ends a word
        edge = edge[edge < len(self.data)]
        begins[edge] = inside[edge + 1]
        edge = edge[edge > 0]
        ends[edge - 1] = inside[edge]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)  # first word of each text, n + 1
        self.count = np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.count)

    @property
    def position(self) -> np.ndarray:
        """Place of each word in its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with ``lower``, A to Z count as a to z."""
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        for low in range(0, len(self.data), _HASH_BYTES):
            high = min(low + _HASH_BYTES, len(self.data))
            byte = self.data[low:high]
            first, last = np.searchsorted(self.start, (low + 1, high))
            begun = low - self.start[first - 1] if first and self.end[first - 1] > low else 0  # bytes of a word before this stretch
            kind = np.int32 if begun < 1 << 22 else np.int64
            begin = np.zeros(high - low, dtype=kind)  # of each byte's word, in this stretch
            begin[self.start[first:last] - low] = self.start[first:last] - low
            place = np.arange(high - low, dtype=kind) - np.maximum.accumulate(begin)
            if begun:
                place[: min(high, self.end[first - 1]) - low] += kind(begun)
            code = place << 8
            code |= _LOWERED[byte] if lower else byte
            far = np.flatnonzero(place >= _PLACES)
            if len(far):
                exact = code[far]
                code[far] = 0
            value = _AT_PLACE[code]
            if len(far):
                value[far] = mix((exact + 1).astype(np.uint64) * np.uint64(_BASE))
            np.cumsum(value, out=sums[low + 1 : high + 1])
            sums[low + 1 : high + 1] += sums[low]
        return mix(sums[self.end] - sums[self.start])

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """A hash of the ``width`` words from each word on, or of fewer where the text ends sooner.

        Runs of 1, 2, 4, ... words are hashed from runs half as long, and a window from the runs that make it up.
        """
        where = np.arange(len(hashes)) + self.text * (width - 1)
        run = np.full(len(hashes) + self.n_texts * (width - 1), _BEYOND, dtype=np.uint64)
        run[where] = hashes
        size, done, out = 1, 0, None
        while True:
            if width & size:
                out = run if out is None else _joined(out, run[done:])
                done += size
            if done == width:
                return out[where]
            run, size = _joined(run, run[size:]), 2 * size


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of runs and the runs that follow them, as far as both go."""
    n = min(len(left), len(right))
    return mix(left[:n] * np.uint64(_BASE) + right[:n] + np.uint64(1))


def long(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as signed 64-bit column values."""
    return pa.array(values.view(np.int64))
