"""Word shingles as 64-bit hashes in numpy, shared by the operators on word shingles."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
KEPT_WORDS = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look independent."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Hashes of words, kept while the task runs; emptied when it holds too many."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the lower-case words of all texts, and where each text begins and ends in them."""
        if len(self) > KEPT_WORDS:
            self.clear()
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        bounds = np.cumsum([0, *map(len, words)])
        return np.fromiter((self[w] for ws in words for w in ws), np.uint64, bounds[-1]), bounds


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; run i starts at word i."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * FACTOR + words[k : k + n]
    return mix(out)


def by_text(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and the text of each; a shingle never crosses texts."""
    hashes = shingle_hashes(words, size)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[: len(hashes)] == owner[size - 1 : size - 1 + len(hashes)]
    return hashes[inside], owner[: len(hashes)][inside]
