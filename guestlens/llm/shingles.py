"""Words and weighted shingles of texts, in bulk."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np

#: Words of a shingle; a shorter text is one shingle of all its words.
SHINGLE = 5
WORD = re.compile(r"\w+")
REMEMBERED_WORDS = 100_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return value


_HASHES = WordHashes()


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of the ``size`` words from each place on; one of all words where they are fewer."""
    size = min(size, hashes.size)
    if not size:
        return np.zeros(0, np.uint64)
    out = np.zeros(hashes.size - size + 1, np.uint64)
    for i in range(size):
        out = out * MULTIPLIER + hashes[i : i + out.size]
    return mixed(out)


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs."""
    return np.unique(shingle_hashes(hashes), return_counts=True)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets: the chance that ProbMinHash picks the same element.

    Sum over common d of 1 / sum over all e of max(x_e / x_d, y_e / y_d); sorting by x_e / y_e turns the inner sums into
    prefix sums.  Two empty sets have similarity 0.
    """
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(keys.size), np.zeros(keys.size)
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    above = np.cumsum(x[::-1])[::-1]
    below = np.cumsum(y) - y
    common = (x > 0) & (y > 0)
    return float((1 / (above[common] / x[common] + below[common] / y[common])).sum())
