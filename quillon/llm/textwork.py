"""Word splitting, word hashes and rolling shingle hashes shared by the operators on texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a worker remembers before it starts afresh, and bytes of those it remembers; bounds memory, not results.
REMEMBERED, LONGEST = 250_000, 100

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once per remembered word."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def space_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() splits at exactly these six bytes."""
    return raw.split()


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k words; empty when there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _P
        out += hashes[i : i + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingle hashes; fewer words make one shingle, none make none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes, min(k, len(hashes))))


def sorted_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
