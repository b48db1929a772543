"""Word shingles of whole texts, hashed in numpy straight from Arrow buffers.

Words are runs of bytes other than ASCII white space; A-Z count as a-z. A word's hash is a polynomial over random
64-bit letters, taken from one running sum over the buffer; a shingle's hash runs over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from blinkframe.llm.frames import slices, text_bytes

SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_BASE = np.uint64(_BASE)
_OVER_WORDS = np.uint64(0xD1B54A32D192ED03)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(20250101).integers(1, 1 << 63, 256, np.uint64)
_LETTER[65:91] = _LETTER[97:123]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for at, base in enumerate((_BASE, _INVERSE)):
            _powers[at] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base)])
    return _powers


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and their number): words never cross texts."""
    inside = ~_SPACE[data]
    before = np.r_[False, inside[:-1]]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    before[edges] = False
    after = np.r_[inside[1:], False]
    ends = bounds[1:][bounds[1:] > 0] - 1
    after[ends] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power(len(data) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_LETTER[data] * up[: len(data)])]
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and their bounds by text; fewer words than ``size`` are one shingle."""
    counts = np.diff(firsts)
    several = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    bounds = np.r_[0, np.cumsum(several)]
    at = np.repeat(firsts[:-1] - bounds[:-1], several) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(counts, size), several)
    value = np.zeros(len(at), np.uint64)
    padded = np.r_[words, np.zeros(size, np.uint64)]
    for j in range(size):
        value = np.where(j < length, value * _OVER_WORDS + padded[at + j], value)
    return mixed(value + length.astype(np.uint64) * _BASE), bounds


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of every text of a column; null texts have none."""
    data, bounds = text_bytes(column)
    for a, b in slices(bounds, SLICE_BYTES):
        piece, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        starts, ends, firsts = word_bounds(piece, own)
        hashes, at = shingle_hashes(word_hashes(piece, starts, ends), firsts, size)
        for x, y in zip(at[:-1], at[1:], strict=True):
            found = np.sort(hashes[x:y])
            yield found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found
