"""Vectorised word splitting and hashing over Arrow string columns.

Words are runs of bytes other than \\x20 and \\x09-\\x0D. No UTF-8 sequence holds such a byte, so
working on bytes equals working on code points. All hashes are fixed functions of the bytes: the
same on every executor and in every run. Arrays are built for slices of at most SLICE_BYTES of
text (or one longer document), so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD1342543DE82EF95)
_Q_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _R)
_TABLE_LOWER = _TABLE.copy()
_TABLE_LOWER[65:91] = _TABLE[97:123]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


@dataclass
class Slice:
    """The words of some consecutive rows: word i is data[starts[i]:ends[i]]."""

    first: int  # row of the batch
    rows: int
    data: np.ndarray  # uint8
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray  # words of row r: ptr[r]..ptr[r+1]

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.ptr))

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_TABLE_LOWER if lower else _TABLE)[self.data] * powers(_R, n), out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * powers(_R_INV, n + 1)[self.starts])

    def words(self, lower: bool = False) -> pa.Array:
        """The words as a string column."""
        inside = self.data[covered(len(self.data), self.starts, self.ends)]
        return strings(self.ends - self.starts, lowered(inside) if lower else inside)

    def row_bytes(self, word_from: int, word_to: int) -> bytes:
        return self.data[self.starts[word_from] : self.ends[word_to - 1]].tobytes()


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `size` bytes lie in spans that don't overlap."""
    edges = np.zeros(size + 1, dtype=np.int8)
    edges[starts] += 1
    edges[ends] -= 1  # the end of a word may be the start of the next row's first
    return np.cumsum(edges[:-1], dtype=np.int8).view(bool)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """A string column from the lengths of its values and all their bytes."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes; rows are not told apart here."""
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers(_Q, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_Q_INV, n + 1)[: n - k + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(texts: pa.Array, separators: np.ndarray = _SPACE, slice_bytes: int | None = None) -> Iterator[Slice]:
    """The rows of a string column, cut into words at bytes that `separators` marks; null counts as empty."""
    slice_bytes = slice_bytes or SLICE_BYTES
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    everything = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    r, n = 0, len(texts)
    while r < n:
        stop = max(r + 1, int(np.searchsorted(offsets, offsets[r] + slice_bytes, side="right")) - 1)
        data = everything[offsets[r] : offsets[stop]]
        bounds = offsets[r : stop + 1] - offsets[r]
        blank = np.ones(len(data) + 1, dtype=bool)
        blank[:-1] = separators[data]
        opens = ~blank[:-1]
        fresh = np.ones(len(data), dtype=bool)
        fresh[1:] = blank[:-2] if len(data) > 1 else fresh[1:]
        inner = bounds[:-1][bounds[:-1] < len(data)]
        fresh[inner] = True
        starts = np.flatnonzero(opens & fresh)
        last = blank[1:].copy()
        last[bounds[1:][bounds[1:] > 0] - 1] = True
        ends = np.flatnonzero(opens & last) + 1
        yield Slice(r, stop - r, data, starts, ends, np.searchsorted(starts, bounds))
        r = stop
