"""Words and n-grams of a text as 64-bit numbers, for use inside tasks.

A word is a run of bytes other than ASCII white space (space, tab to carriage
return), which is what ``bytes.split()`` cuts at. A word's number is its
64-bit hash; an n-gram's number is an odd-weighted sum of its words' numbers,
mixed once. Two different n-grams share a number with probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

# Odd 64-bit multipliers, one per position in an n-gram, and for mixing.
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
# Words whose numbers a task remembers; the store is emptied beyond it, which changes no result.
REMEMBERED_WORDS = 150_000


class WordNumbers(dict):
    """Number of a word, computed on first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = xxhash.xxh3_64_intdigest(word)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def ngrams(numbers: np.ndarray, n: int) -> np.ndarray:
    """Numbers of all windows of ``n`` words, in order; none when the text is shorter."""
    count = len(numbers) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = numbers[:count] * _ODD[0]
    for k in range(1, n):
        total += numbers[k : k + count] * _ODD[k]
    total ^= total >> np.uint64(32)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return total


def shingle_set(numbers: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles; a shorter text is one shingle, an empty one none."""
    if len(numbers) == 0:
        return np.empty(0, dtype=np.uint64)
    if len(numbers) < n:
        whole = ngrams(numbers, len(numbers)) ^ np.uint64(len(numbers))
        return whole
    return np.unique(ngrams(numbers, n))
