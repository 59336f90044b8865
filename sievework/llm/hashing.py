"""Words as 64-bit numbers, and n-gram keys from them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker remembers; others are hashed again.
MOST_WORDS = 100_000
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word holds a line end


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MOST_WORDS:
            self[word] = h
        return h


_known = _Words()


def hash_words(text: bytes | None) -> np.ndarray:
    """64-bit hash of each word between ASCII white space, A-Z in lower case."""
    w = (text or b"").lower().split()
    return np.fromiter(map(_known.__getitem__, w), np.uint64, len(w))


#: Odd multipliers, one for each place in an n-gram.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) ** 3 % (1 << 64) | 1 for i in range(16)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (murmur's finalizer)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """One number per row of columns of hashes, in which order counts."""
    out = columns[0] * PLACES[0]
    for c, place in zip(columns[1:], PLACES[1:], strict=False):
        out = out + c * place
    return mixed(out)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of `size` consecutive words; all words as one where there are fewer; none of none."""
    if not len(words):
        return words
    size = min(size, len(words))
    return np.unique(chained([words[i : len(words) - size + 1 + i] for i in range(size)]))
