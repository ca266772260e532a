"""Fast similarity sketches of hash sets.

Round after round throws every element into one of T bins under a fresh hash; a bin keeps the least value, and a
value of an earlier round is always less than one of a later. After T rounds each further round serves one bin
alone, so every coordinate is filled at last, and mostly after few rounds: about T log T throws in all. Coordinates
agree between two sets with the probability of their resemblance and concentrate as independent samples do.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.shingles import mixed

_ROUND = np.uint64(0xD1B54A32D192ED03)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 48) - 1)
_SHIFT = np.uint64(48)


def similarity_sketch(found: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a set of 64-bit hashes; all equal for the empty set."""
    out = np.full(t, _EMPTY, np.uint64)
    n = len(found)
    if not n:
        return out
    done, enough = 0, int(t * (np.log(t) + 2) / n) + 1
    while done < t and (out == _EMPTY).any():
        rounds = np.arange(done, min(t, done + enough), dtype=np.uint64)
        h = mixed(found[None, :] + (rounds[:, None] + np.uint64(1)) * _ROUND)
        # the bin from the high half, the value from the low bits: they must not depend on each other
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        values = (mixed(h) & _LOW) | (rounds[:, None] << _SHIFT)
        np.minimum.at(out, bins.ravel().astype(np.int64), values.ravel())
        done, enough = done + len(rounds), max(1, enough // 4)
    for j in np.flatnonzero(out == _EMPTY).tolist():
        at = np.array([t + j], np.uint64)
        out[j] = (mixed(found + (at + np.uint64(1)) * _ROUND) & _LOW).min() | (at << _SHIFT)[0]
    return out


def band_hashes(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit hash of each run of `rows` coordinates and its place."""
    parts = sketch.reshape(-1, rows)
    h = np.arange(1, len(parts) + 1, dtype=np.uint64) * _ROUND
    for i in range(rows):
        h = mixed(h + parts[:, i])
    return h.view(np.int64)
