"""Elias-Fano sequences and the levels of an n-gram trie, in numpy.

A monotone sequence keeps the low bits of its values packed and the high bits in unary:
2 + log2(universe / length) bits a value.  A level's successors become monotone by
adding to each child's number the running total of the ranges before it, so that a parent's
children, found by two monotone pointers, are searched among the whole level's values.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

U = np.uint64


def pack_bits(x: np.ndarray, width: int) -> np.ndarray:
    """Numbers of width (up to 57) bits one after the other, as bytes, and eight more bytes."""
    if not width or not len(x):
        return np.zeros(8, np.uint8)
    bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :]
    return np.concatenate((np.packbits(bits.reshape(-1)), np.zeros(8, np.uint8)))


def unpack_bits(raw: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The numbers at the places at; reads only the eight bytes that each starts in."""
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * width
    from_each_byte = np.ndarray((len(raw) - 7,), ">u8", np.ascontiguousarray(raw), strides=(1,))
    return (from_each_byte[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)) >> U(64 - width)


#: Each byte of a word one; the top bit of each; place of the k-th one bit of a byte, at 8 * byte + k.
ONES, TOPS = U(0x0101010101010101), U(0x8080808080808080)
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).reshape(-1)
#: One bits between two entries of the select directory, as a power of two.
SAMPLE = 6
#: Values read at a time, so that what lies between the steps stays in a processor's cache.
CHUNK = 1 << 14


def select_in_words(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one bit, from the least bit, of each 64-bit word."""
    x = words - ((words >> U(1)) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
    upto = ((x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * ONES  # one bits up to and with each byte
    at = ((((k * ONES | TOPS) - upto) & TOPS) >> U(7)) * ONES >> U(56) << U(3)  # bytes whose sum is at most k
    before = (upto << U(8)) >> at & U(0xFF)
    return at + IN_BYTE[((words >> at & U(0xFF)) << U(3)) + k - before]


class EliasFano:
    """A monotone sequence; at(i) gives values, find(value, lo, hi) successors in ranges.

    The high bits stay as they are mapped.  A select directory, made at the first read, has the one
    bits before each word and the word of every 64th one bit: some 1.5 bits a value.  A read
    looks between two of the latter and then into one word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self._before: np.ndarray | None = None
        self._sample = self._words = None

    @classmethod
    def of(cls, x: np.ndarray) -> EliasFano:
        x, n = x.astype(np.uint64), len(x)
        width = min(57, max(0, int(int(x[-1]) // n).bit_length() - 1)) if n else 0
        high = np.zeros(-(-((int(x[-1]) >> width) + n + 1) // 64) * 64 if n else 0, np.uint8)
        high[(x >> U(width)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, width, pack_bits(x & U((1 << width) - 1), width), np.packbits(high, bitorder="little"))

    def dump(self) -> bytes:
        return struct.pack("<QIQQ", self.n, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, raw: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, width, low, high = struct.unpack_from("<QIQQ", raw, at)
        at += 28
        return cls(n, width, raw[at : at + low], raw[at + low : at + low + high]), at + low + high

    def _directory(self) -> None:
        self._words = np.ndarray((len(self.high) // 8,), "<u8", np.ascontiguousarray(self.high))
        ones = np.cumsum(np.bitwise_count(self._words), dtype=np.uint32 if self.n < 1 << 32 else np.uint64)
        self._sample = np.append(np.searchsorted(ones, np.arange(0, self.n, 1 << SAMPLE, dtype=ones.dtype), "right"), max(0, len(ones) - 1)).astype(np.uint32)
        self._before = np.concatenate((np.zeros(1, ones.dtype), ones))

    def _places(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each one bit among the high bits, its word)."""
        if self._before is None:
            self._directory()
        group = i >> SAMPLE
        # The word is the last one with at most i one bits before it; most often among the first three.
        word, last = self._sample[group], self._sample[group + 1]
        word += self._before[word + 1] <= i
        word += self._before[word + 1] <= i
        rows = np.flatnonzero(self._before[word + 1] <= i)
        if len(rows):
            lo, hi, want = word[rows] + 1, last[rows], i[rows]
            while (lo < hi).any():
                mid = (lo + hi) >> 1
                later = self._before[mid + 1] <= want
                lo, hi = np.where(later, np.minimum(mid + 1, hi), lo), np.where(later, hi, mid)
            word[rows] = lo
        bits = self._words[word]
        return (word.astype(np.uint64) << U(6)) + select_in_words(bits, (i - self._before[word]).astype(np.uint64)), bits

    def _values(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - i.astype(np.uint64)) << U(self.width)) | unpack_bits(self.low, self.width, i)

    def at(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        out = np.empty(len(i), np.uint64)
        for k in range(0, len(i), CHUNK):
            part = i[k : k + CHUNK]
            out[k : k + CHUNK] = self._values(part, self._places(part)[0])
        return out

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at i and at i + 1, the second's place being the next one bit, most often of the same word."""
        i = np.asarray(i, np.int64)
        first, second = np.empty(len(i), np.uint64), np.empty(len(i), np.uint64)
        for k in range(0, len(i), CHUNK):
            part = i[k : k + CHUNK]
            place, bits = self._places(part)
            first[k : k + CHUNK] = self._values(part, place)
            rest = bits >> (place & U(63)) & ~U(1)
            following = place + np.bitwise_count((rest & (~rest + U(1))) - U(1))
            rows = np.flatnonzero(rest == 0)
            if len(rows):
                following[rows] = self._places(part[rows] + 1)[0]
            second[k : k + CHUNK] = self._values(part + 1, following)
        return first, second

    def find(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place in lo..hi whose value is at least value, hi if none is; whether the two are equal)."""
        lo, hi = lo.astype(np.int64).copy(), hi.astype(np.int64).copy()
        equal = np.zeros(len(lo), bool)
        rows = np.flatnonzero(lo < hi)
        while len(rows):
            mid = (lo[rows] + hi[rows]) >> 1
            have, want = self.at(mid), value[rows]
            less = have < want
            lo[rows[less]] = mid[less] + 1
            hi[rows[~less]] = mid[~less]
            equal[rows] |= have == want
            rows = rows[lo[rows] < hi[rows]]
        return lo, equal


class Level:
    """Children of parents 0, 1, ...: pointers, child numbers relative to their parent, codes."""

    def __init__(self, pointers: EliasFano, children: EliasFano, span: int, codes: np.ndarray):
        self.pointers, self.children, self.span, self.codes = pointers, children, span, codes

    @classmethod
    def of(cls, counts: np.ndarray, child: np.ndarray, codes: np.ndarray) -> Level:
        """counts: children of each parent; child: their numbers, ascending within a parent."""
        span = int(child.max()) + 1 if len(child) else 1
        parent = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        return cls(EliasFano.of(np.concatenate(([0], np.cumsum(counts)))), EliasFano.of(parent * U(span) + child.astype(np.uint64)), span, codes.astype(np.uint8))

    def dump(self) -> bytes:
        return struct.pack("<QQ", self.span, len(self.codes)) + self.pointers.dump() + self.children.dump() + self.codes.tobytes()

    @classmethod
    def load(cls, raw: np.ndarray, at: int = 0) -> Level:
        span, n = struct.unpack_from("<QQ", raw, at)
        pointers, at = EliasFano.load(raw, at + 16)
        children, at = EliasFano.load(raw, at)
        return cls(pointers, children, span, raw[at : at + n])

    def range(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parent = np.asarray(parent, np.int64)
        lo, hi = self.pointers.pairs(parent)
        return lo.astype(np.int64), hi.astype(np.int64)

    def search(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Node of each (parent, child number), or -1."""
        lo, hi = self.range(parent)
        known = child < self.span
        value = np.asarray(parent).astype(np.uint64) * U(self.span) + np.minimum(child, self.span - 1).astype(np.uint64)
        place, equal = self.children.find(value, lo, hi)
        return np.where(known & equal, place, -1)


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Unsigned arrays by byte planes of the least width, compressed."""
    out = []
    for x in arrays:
        x = np.asarray(x).astype("<u8")
        width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
        out += [struct.pack("<QB", len(x), width), np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.compress(b"".join(out), level)


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        n, width = struct.unpack_from("<QB", raw, at)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(x.view("<u8").reshape(-1))
        at += 9 + n * width
    return out
