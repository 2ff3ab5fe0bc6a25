"""Task-side helpers: word hashes and shingle sets of a text as sorted 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

from assayline.llm.workers import held

MEMO_WORDS = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, of the whole text."""
    return (text or "").encode().lower().split()


class _Hashes(dict):
    """Hashes of the words met lately; a long word is hashed wherever it stands."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    memo = held("word hashes", _Hashes)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words, in order."""
    n = len(hashes) - width + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    if n <= 0:
        return total
    for i in range(width):
        total = mixed(total + hashes[i : i + n] * _ODD[i % 4] + np.uint64(i + 1))
    return total


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingles; fewer words than ``width`` make one shingle, none make none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = word_hashes(words)
    return np.unique(windows(hashes, min(width, len(words))) ^ np.uint64(min(width, len(words)) - width & 0xFFFF))
