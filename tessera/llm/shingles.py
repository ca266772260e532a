"""Word shingles of whole texts as 64-bit hashes, computed by numpy inside tasks.

Words are runs of characters other than ASCII white space, A-Z lower-cased. A shingle's hash combines the
64-bit hashes of its words in order, so it depends on nothing but the words. Fewer words than a shingle: the
whole sequence is one. No words: no shingle.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """The text's words as UTF-8, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def combined(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence where it is shorter."""
    n = min(size, len(h))
    if not n:
        return np.empty(0, np.uint64)
    count = len(h) - n + 1
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out = mixed(out * _STEP + h[i : i + count])
    return out


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """The hash of each shingle as it comes in the text, repeats included."""
    return combined(word_hashes(text), size)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, size))
