"""Vectorised helpers for Arrow batches: bounded slices, words, and rolling hashes.

All work inside one task on arrays of bounded size. A slice holds about ``limit`` bytes of
text, or one longer document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; the arrays of a slice take about 60 times as much.
SLICE_BYTES = 1 << 19

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    values = values.astype(np.uint64, copy=False)
    values = values ^ (values >> np.uint64(30))
    values *= _MIX[0]
    values ^= values >> np.uint64(27)
    values *= _MIX[1]
    values ^= values >> np.uint64(31)
    return values


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of 64-bit values."""
    return mix(mix(left + np.uint64(0x632BE59BD9B4E019)) + right)


@dataclass
class Slice:
    """Some consecutive rows of a batch: bytes of their texts, and where each text begins."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into slices; a null counts as an empty text."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        after = min(after, len(texts))
        yield Slice(first, data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first])
        first = after
    pa.default_memory_pool().release_unused()  # a worker may idle for long after this batch


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """A large object that a worker keeps for its next tasks, in place of the one it kept before."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drop what an earlier operator's tasks left in this worker."""
    _HELD.clear()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(length: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    known = _POWERS.get(which)
    if known is None or len(known[0]) < length:
        size = max(length, SLICE_BYTES + 1)
        base = _BASES[which]
        tables = []
        for value in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, value, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        known = tables[0], tables[1]
        if size <= 4 * SLICE_BYTES:
            _POWERS[which] = known
    return known


class Prefixes:
    """Polynomial prefix sums of a sequence: a 64-bit hash of any part of it at once.

    Parts are compared by content, wherever they lie. Two of these with different bases,
    or one with another hash, make collisions negligible.
    """

    def __init__(self, symbols: np.ndarray, which: int = 0):
        self.powers, self.inverse = _powers(len(symbols) + 1, which)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self.powers[: len(symbols)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        part = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(part + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a slice; words of row r are ``rows[r]:rows[r + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def find_words(part: Slice) -> Words:
    """Words are runs of bytes other than space and 0x09-0x0D, inside one text."""
    data, size = part.data, len(part.data)
    inside = np.zeros(size + 1, bool)
    inside[:size] = ~_SPACE[data]
    begins = inside[:size].copy()
    begins[1:] &= ~inside[: size - 1]
    borders = part.bounds[:-1]
    borders = borders[borders < size]
    begins[borders] = inside[borders]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(starts, starts, np.zeros(part.rows + 1, np.int64))
    # a word ends at the next space, or at the end of its text
    stops = ~inside
    stops[part.bounds[1:]] = True
    ends = np.flatnonzero(stops)
    ends = ends[np.searchsorted(ends, starts, "right")]
    return Words(starts, ends, np.searchsorted(starts, part.bounds))


def word_hashes(part: Slice, words: Words, lower: bool) -> np.ndarray:
    data = LOWER[part.data] if lower else part.data
    return Prefixes(data).of(words.starts, words.ends)
