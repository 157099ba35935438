"""Word shingles of texts as 64-bit hashes.

Words are what stands between the bytes 0x20 and 0x09-0x0D, A-Z in lower case.  A shingle is
five consecutive words; a text with fewer has all its words as its one shingle, and a
text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import own_cache

SIZE = 5
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; a permutation of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    own_cache("word hashes", _hashes.clear)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Hashes of all shingles of one text, in order, from its words' hashes."""
    n = len(h)
    if not n:
        return h
    span = min(size, n)
    out = np.full(n - span + 1, U(span))
    for k in range(span):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[k : n - span + 1 + k])
    return out


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return distinct(shingles(word_hashes(words_of(text))))


def counted(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """(sorted distinct shingle hashes, how often each occurs); no counts if all are equal."""
    values, counts = np.unique(shingles(word_hashes(words_of(text))), return_counts=True)
    return values, counts if len(counts) and counts.max() > counts.min() else None


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def probability_jaccard(a: np.ndarray, wa: np.ndarray | None, b: np.ndarray, wb: np.ndarray | None) -> float:
    """Of two sorted sets with weights (None: equal ones): the sum over common elements d of
    1 / sum over e of max(wa[e] / wa[d], wb[e] / wb[d]).  It doesn't depend on the scale of either's
    weights, and is the Jaccard similarity where both have equal ones.

    The inner sum splits by the ratio wa / wb: elements whose ratio is at least that of d count by wa,
    the others by wb, so that one sort by ratio gives all sums."""
    if not len(a) or not len(b):
        return 0.0
    values, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.zeros(len(values)), np.zeros(len(values))
    x[at[: len(a)]], y[at[len(a) :]] = 1.0 if wa is None else wa, 1.0 if wb is None else wb
    ratio = np.divide(x, y, out=np.full(len(values), np.inf), where=y > 0)
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    lower = np.searchsorted(ratio, ratio)  # elements of lower ratio
    from_x, until_y = x.sum() - np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(y)))
    both = (x > 0) & (y > 0)
    lower, ratio = lower[both], ratio[both]
    return float((x[both] / (from_x[lower] + ratio * until_y[lower])).sum())
