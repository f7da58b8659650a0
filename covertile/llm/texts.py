"""Words, word hashes and shingle hashes of one text, for use inside tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are taken with numpy over
all words of a text at once; the hash of a word is kept in a bounded dictionary of the Python
worker, as a few thousand words make up most of any corpus.
"""

from __future__ import annotations

import numpy as np
import xxhash

KEPT_WORDS = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)
_SHIFT = np.uint64(29)


def words_of(text: str | None, fold: bool = False) -> list[bytes]:
    """The words of a text as UTF-8; ``fold`` lower-cases A-Z. None has no words."""
    if not text:
        return []
    raw = text.encode("utf-8")
    return (raw.lower() if fold else raw).split()


class WordHashes(dict):
    """word -> XXH64 of its UTF-8 bytes. Emptied when full, which costs time but no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the high bits."""
    x = (x ^ (x >> _SHIFT)) * _ODD[1]
    x = (x ^ (x >> _SHIFT)) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words, in order; none for a shorter text."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        factor = _ODD[0] + np.uint64(2 * seed)
        out = np.full(count, np.uint64(n + 1))
        for i in range(n):
            out = out * factor + hashes[i : i + count]
        return mixed(out)
