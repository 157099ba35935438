"""Suffix arrays by two-stage sorting, in numpy.

A suffix is small (S) if it is less than its successor, else large (L).  The small
ones are sorted directly, eight bytes at a time; the large ones are induced: buckets of
first bytes are scanned in order, and each suffix met puts its predecessor, if that is
large, at the end of the large part of the predecessor's bucket.  Large parts come
before small parts.  Whole buckets are moved at once; within a bucket a scan repeats
for runs of its byte.
"""

from __future__ import annotations

import numpy as np


def words8(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on as one big-endian number; zeros after the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(text)]
    return out


def small_type(text: np.ndarray) -> np.ndarray:
    """True where the suffix is less than its successor; the end counts as less than any byte."""
    n = len(text)
    last = np.flatnonzero(np.concatenate((text[1:] != text[:-1], [True])))  # ends of runs of one byte
    less = np.zeros(len(last), bool)
    less[:-1] = text[last[:-1]] < text[last[:-1] + 1]
    return np.repeat(less, np.diff(np.concatenate(([-1], last)))) if n else np.zeros(0, bool)


def sort_directly(at: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the depth bytes from there on; ties stay in order of position."""
    n, first = len(keys), keys[at]
    order = np.argsort(first, kind="stable")
    at, first = at[order], first[order]
    new = np.concatenate(([True], first[1:] != first[:-1])) if len(at) else np.zeros(0, bool)
    for d in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        group = np.cumsum(new)[rows]
        p = at[rows] + d
        key = np.where(p < n, keys[np.minimum(p, n - 1)], np.uint64(0))
        order = np.lexsort((key, group))
        at[rows], key, group = at[rows][order], key[order], group[order]
        new[rows[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return at


def suffix_array(text: np.ndarray, depth: int | None = None, wanted: np.ndarray | None = None, keys: np.ndarray | None = None) -> np.ndarray:
    """Positions in the order of their suffixes.

    depth: only so many bytes (and the large ones before them) decide; all by default.
    wanted: mask of positions to return; only these and what induces them are sorted.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    keys = words8(text) if keys is None else keys
    small = small_type(text)
    if wanted is None:
        need = np.ones(n, bool)
    else:
        # a large suffix needs its successors up to the next small one
        need = wanted.copy()
        stop = np.flatnonzero(small)
        run = np.flatnonzero(wanted & ~small)
        end = np.append(stop, n - 1)[np.searchsorted(stop, run)]
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, run, 1)
        np.add.at(mark, end + 1, -1)
        need |= np.cumsum(mark[:n]) > 0
    sorted_small = sort_directly(np.flatnonzero(small & need), keys, n + 8 if depth is None else depth)
    edge = np.searchsorted(text[sorted_small], np.arange(257, dtype=np.int64))
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not small[n - 1] and need[n - 1]:
        large[text[n - 1]].append(np.array([n - 1]))  # the end, which comes before all, induces the last suffix
    out = []
    for c in range(256):
        mine = large[c]
        part = sorted_small[edge[c] : edge[c + 1]]
        if not mine and not len(part):
            continue
        wave = np.concatenate(mine) if mine else np.zeros(0, np.int64)
        waves = [wave]
        while len(wave):  # predecessors with the same byte are large too, and follow in this bucket
            p = wave[wave > 0] - 1
            wave = p[(text[p] == c) & need[p]]
            waves.append(wave)
        bucket = np.concatenate([*waves, part])
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[(text[p] > c) & need[p]]
        if len(p):
            b = text[p]
            order = np.argsort(b, kind="stable")
            p, b = p[order], b[order]
            cut = np.flatnonzero(b[1:] != b[:-1]) + 1
            for q in np.split(p, cut):
                large[text[q[0]]].append(q)
    sa = np.concatenate(out) if out else np.zeros(0, np.int64)
    return sa if wanted is None else sa[wanted[sa]]


def adjacent_prefixes(keys: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix length, up to cap, of each position in sa with the one before it (0 for the first)."""
    n, out = len(keys), np.zeros(len(sa), np.int64)
    rows = np.arange(1, len(sa))
    for d in range(0, cap, 8):
        p, q = sa[rows] + d, sa[rows - 1] + d
        x = np.where(p < n, keys[np.minimum(p, n - 1)], np.uint64(0)) ^ np.where(q < n, keys[np.minimum(q, n - 1)], np.uint64(0))
        same = x == 0
        differ = x[~same]
        byte = np.zeros(len(differ), np.int64)
        for k in range(1, 8):
            byte += (differ >> np.uint64(64 - 8 * k)) == 0
        out[rows[~same]] += byte
        rows = rows[same]
        out[rows] += 8
    return np.minimum(np.minimum(out, cap), np.minimum(n - sa, n - np.concatenate((sa[:1], sa[:-1])))) if len(sa) else out
