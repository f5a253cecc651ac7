"""Words of many texts at once, as arrays: boundaries and 64-bit hashes from an Arrow string column.

A word is a run of bytes other than space and \\t..\\r, the UTF-8 form of
``[^\\x20\\x09-\\x0D]+``.  The hash of a byte range is a polynomial in an odd base modulo
2**64 over random byte codes, taken from prefix sums, so a range of any length costs the
same; it is then mixed with the length.  Texts are worked on in blocks of about a
megabyte; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER_CODES = CODES.copy()
LOWER_CODES[65:91] = CODES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, kept between calls."""
    global _powers, _inverse
    while len(_powers) < n:
        k = len(_powers)
        up, down = np.uint64(pow(_BASE, k, 1 << 64)), np.uint64(pow(_INVERSE, k, 1 << 64))
        _powers, _inverse = np.concatenate([_powers, _powers * up]), np.concatenate([_inverse, _inverse * down])
    return _powers[:n], _inverse[:n]


class Ranges:
    """Prefix sums over ``values``; ``hash(a, b)`` hashes values[a:b] for arrays of bounds."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * _M2)


class Block:
    """Texts first..last-1 of a batch: bytes, and words with the text each belongs to.

    ``starts``/``ends`` are byte positions in ``buf``, ``bounds[i]:bounds[i+1]`` the words of
    text i, ``hashes`` the word hashes.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool, first: int, gaps: np.ndarray = SPACE) -> None:
        self.buf, self.offsets, self.first = buf, offsets, first
        self.n = len(offsets) - 1
        self.solid = ~gaps[buf]
        begin = self.solid.copy()
        begin[1:] &= ~self.solid[:-1]
        end = np.zeros(len(buf) + 1, bool)
        end[1:-1] = self.solid[:-1] & ~self.solid[1:]
        if len(buf):
            end[-1] = self.solid[-1]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        begin[inner] = self.solid[inner]
        end[inner] = self.solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.ranges = Ranges((LOWER_CODES if lower else CODES)[buf])
        self.hashes = self.ranges.hash(self.starts, self.ends)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """The number of set flags (one a byte) in each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.offsets])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words that lie in one text, and the word each starts at."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.room() >= k)
        return Ranges(mix(self.hashes)).hash(at, at + k), at

    def room(self) -> np.ndarray:
        """For each word, the words from it to the end of its text."""
        sizes = np.diff(self.bounds)
        return np.repeat(self.bounds[1:], sizes) - np.arange(len(self.hashes))


def blocks(column: pa.Array, lower: bool = False, target: int = 1 << 20, gaps: np.ndarray = SPACE) -> Iterator[Block]:
    """Cut an Arrow string column (nulls: empty texts) into blocks of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.string()), False
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1)
        yield Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower, i, gaps)
        i = j
