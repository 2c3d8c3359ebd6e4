"""Sets of 5-word shingles as 64-bit hashes, and their circulant MinHash signatures."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from eventloom.llm.arrays import Slice, find_words, mix, pair_hash, word_hashes


@dataclass
class Sets:
    """Sorted distinct shingles of each row of a slice: ``values[bounds[r]:bounds[r + 1]]``."""

    values: np.ndarray
    bounds: np.ndarray


def shingle_sets(part: Slice, size: int = 5) -> Sets:
    """Words are runs without white space, A-Z in lower case; with fewer than ``size`` words
    the whole sequence is the one shingle; without words the set is empty."""
    words = find_words(part)
    hashes, counts = word_hashes(part, words, lower=True), np.diff(words.rows)
    rows = words.row_of()
    grams = hashes.copy()
    for step in range(1, size):
        follows = np.concatenate([hashes[step:], np.zeros(min(step, len(hashes)), np.uint64)])[: len(hashes)]
        inside = words.rows[rows + 1] - np.arange(len(hashes)) > step
        grams = np.where(inside, pair_hash(grams, follows), grams)
    # a shingle begins at every word that has enough words after it, or at the first of a short text
    begins = np.arange(len(hashes)) - words.rows[rows] <= np.maximum(counts[rows] - size, 0)
    grams, rows = grams[begins], rows[begins]
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[fresh], rows[fresh]
    return Sets(grams, np.searchsorted(rows, np.arange(part.rows + 1)))


def set_hashes(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each set, equal for equal sets."""
    out = []
    for salt in (np.uint64(0x1F123BB5), np.uint64(0x159A55E5)):
        sums = np.zeros(len(sets.values) + 1, np.uint64)
        np.cumsum(mix(sets.values + salt), out=sums[1:])
        out.append(sums[sets.bounds[1:]] - sums[sets.bounds[:-1]])
    return out[0], out[1]


def _permuted(values: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    values = values ^ (values >> np.uint32(16))
    values *= np.uint32(0x7FEB352D)
    values ^= values >> np.uint32(15)
    values *= np.uint32(0x846CA68B)
    values ^= values >> np.uint32(16)
    return values


def signatures(sets: Sets, coordinates: int) -> np.ndarray:
    """Circulant MinHash: rows x coordinates; rows of empty sets are zero.

    One permutation deals the shingles out to places on a circle of 2**32; coordinate k is the
    least image, under a second permutation shifted by k places, of the places of the set.
    """
    out = np.zeros((len(sets.bounds) - 1, coordinates), np.uint32)
    full = np.flatnonzero(np.diff(sets.bounds))
    if len(full):
        places = (mix(sets.values) >> np.uint64(32)).astype(np.uint32)
        starts = sets.bounds[:-1][full]
        for k in range(coordinates):
            out[full, k] = np.minimum.reduceat(_permuted(places - np.uint32(k)), starts)
    return out


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of ``rows`` coordinates."""
    bands = signature.astype(np.uint64).reshape(len(signature), -1, rows)
    out = np.zeros(bands.shape[:2], np.uint64) + np.arange(bands.shape[1], dtype=np.uint64)
    for row in range(rows):
        out = pair_hash(out, bands[:, :, row])
    return out
