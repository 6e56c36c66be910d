"""Word shingles of whole texts as numpy arrays, a batch of texts at a time.

A text is lower-cased in A-Z, cut at ``[\\x20\\x09-\\x0D]+`` and hashed word by word; five
neighbouring words make a shingle.  A text with one to four words has one shingle, its whole word
sequence; one without words has none.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

SHINGLE = 5
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer (fixed public constants)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt))


_COMBINE = seeds(SHINGLE, 17) | U(1)
_SHORT = seeds(SHINGLE, 29)


def byte_words(text: str | None) -> list[bytes]:
    """bytes.lower() touches only A-Z and bytes.split() cuts only at the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), U, len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each shingle position of one text, from its word hashes."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            total = _SHORT[n]
            for k in range(n):
                total = total + mix(words[k : k + 1] + _COMBINE[k])[0]
            return mix(np.array([total], U))
        total = words[: n - SHINGLE + 1] * _COMBINE[0]
        for k in range(1, SHINGLE):
            total = total + mix(words[k : n - SHINGLE + 1 + k] * _COMBINE[k])
        return mix(total)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    return np.unique(shingle_hashes(word_hashes(byte_words(text))))


def fingerprint(members: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set of shingles."""
    return int.from_bytes(xxh3_64_intdigest(members.tobytes(), len(members)).to_bytes(8, "little"), "little", signed=True)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers; empty sets are similar to nothing."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def band_hashes(sketch: np.ndarray, bands: int, salt: int) -> np.ndarray:
    """One hash for each band of consecutive sketch coordinates; the band's number enters it."""
    rows = sketch.reshape(bands, -1)
    with np.errstate(over="ignore"):
        total = seeds(bands, salt)
        for k in range(rows.shape[1]):
            total = mix(total ^ rows[:, k]) + U(k)
    return mix(total).view(np.int64)
