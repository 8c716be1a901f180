"""One-permutation MinHash signatures with optimal densification, as band keys."""

from __future__ import annotations

import numpy as np

from retentio.llm.tokens import mix

BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _probes(depth: int) -> np.ndarray:
    """For each bin, the bins to borrow from in turn: a fixed random sequence, the same for every set."""
    n = np.arange(BINS * depth, dtype=np.uint64) + np.uint64(1)
    return (mix(n * _GOLD) % np.uint64(BINS)).astype(np.int32).reshape(depth, BINS).T


_PROBES = _probes(8192)
_ODD = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD * np.uint64(3))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each of ``BINS`` equal ranges of the (sorted) hashes; an empty bin takes the value of the first
    filled bin on its own probe sequence, so that every bin of two sets agrees with the probability of their similarity."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    filled[bins[first]] = True
    out[bins[first]] = shingles[first]
    empty = np.flatnonzero(~filled)
    depth = 16
    while len(empty) and depth <= _PROBES.shape[1]:
        tries = _PROBES[empty, :depth]
        hit = filled[tries]
        found = hit.any(axis=1)
        source = tries[found, hit[found].argmax(axis=1)]
        out[empty[found]] = out[source]
        empty = empty[~found]
        depth *= 8
    out[empty] = shingles[0]
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    rows = mix(signature(shingles)).reshape(BANDS, ROWS)
    return mix((rows * _ODD).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


# Bits of the parity map of a set: two sets differ in at least as many elements as their maps differ in bits.
MAP_BITS = 2048


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """``MAP_BITS`` bits; each tells whether an odd number of elements fall on it."""
    at = np.bincount((mix(shingles + _GOLD) % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS)
    return np.packbits((at & 1).astype(bool))
