"""Adaptive context-mixing range coder for token ids.

A file's ids are cut into blocks that are coded independently: tables, weights and predictions start
afresh in each, and nothing but a block's words, its length and the
largest id is needed to decode it.  The probability of an id is the mixture of three predictions,

    P(id) = a [id = order-2 guess] + b [id = order-1 guess] + (1 - a - b) P0(id),

where the guesses are what last followed the last two ids and the last id, from tables hashed by them,
with how often each held in a row, up to 7, and a and b are learned for every pair of these,
whether the guesses agree, and whether the order-2 guess held the last two times.  P0, the order-0 prediction, has
the frequencies of the ids that the guesses missed; one that it doesn't know yet, or that is rarer than
its steps, follows an escape in plain digits.  The interval of each id drives a range coder (48-bit window,
24-bit words, exact carries).

A block is cut into lanes that are coded in lockstep, one element of a numpy vector each, so
that no Python code runs per id.  All lanes share the block's model: guess tables learn from every id at once,
weights and P0 from all ids since they were last renewed, at first after every
step and later after an eighth more of them, or REFRESH.  The coder's numbers are whole doubles under 2 ** 53, so
its arithmetic is exact.  Every block has its own CRC-32, which decoding
checks; a damaged block raises ValueError with its number.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMIXRC3\n"
BLOCK = 3 << 21  # ids
LANES, STEPS = 4096, 512  # most lanes of a block; ids that a lane should have at least
SLOTS1, SLOTS2 = 1 << 16, 1 << 20  # of the guess tables
ONE, IDS = np.uint32(1 << 24), np.uint32((1 << 24) - 1)  # how often a guess held is above its id
MEMORY = 1 << 16  # ids that a context's weights go by at most
REFRESH = 32  # steps after which weights and P0 are renewed at the latest
WORD, LEAST = 2.0**24, 2.0**24  # of the coder; its range is between LEAST and WORD ** 2
TOTAL, TOTAL0 = 2.0**22, 1 << 16  # of an id's interval, and of P0's
DIRECT = 1 << 20  # ids below it are found by an array, others by a search


def widths_of(top: int) -> list[int]:
    """Bits of the digits of ids up to top, the first digit first; 16 bits at least."""
    return [16] if top < 1 << 16 else [int(top).bit_length() - 16, 16]


class _Order0:
    """Frequencies of ids, in steps of 1 / TOTAL0; the last place is the escape's."""

    def __init__(self, bits: int):
        self.direct = bits <= DIRECT.bit_length() - 1
        self.seen = np.zeros(1 << bits if self.direct else 0, np.int64)  # counts, of ids or of self.names
        self.names = np.zeros(0, np.uint32)
        self.place = np.zeros(1 << bits if self.direct else 0, np.int64)
        self.escaped, self.total = 0, 0
        self._lay_out(np.zeros(0, np.uint32), np.zeros(0, np.int64), TOTAL0)

    def learn(self, ids: np.ndarray, escaped: int) -> None:
        if self.direct:
            self.seen += np.bincount(ids, minlength=len(self.seen))
            known = np.flatnonzero(self.seen)
            counts = self.seen[known]
        else:
            self.names, back = np.unique(np.concatenate((self.names, ids)), return_inverse=True)
            self.seen = np.bincount(back, np.concatenate((self.seen, np.ones(len(ids)))), len(self.names)).astype(np.int64)
            known, counts = self.names, self.seen
        self.escaped = self.escaped / 2 + escaped  # of the last rounds most
        self.total = self.total / 2 + len(ids)
        share = min(max(int(TOTAL0 * (self.escaped + 1) / (self.total + 2)), 1), TOTAL0 // 2)
        often = counts * (TOTAL0 - share) >= counts.sum()
        self._lay_out(known[often], counts[often], share)

    def _lay_out(self, known: np.ndarray, counts: np.ndarray, escape: int) -> None:
        n = len(known)
        bounds = np.cumsum(counts) * (TOTAL0 - escape) // max(int(counts.sum()), 1)
        ends = np.concatenate((bounds, [TOTAL0]))
        self.known, self.n = np.concatenate((known, [0])).astype(np.uint32), n
        freq = np.diff(ends, prepend=0)
        self.start, self.freq = (ends - freq).astype(np.float64), freq.astype(np.float64)
        self.look = np.repeat(np.arange(n + 1), freq)
        if self.direct:
            self.place.fill(n)
            self.place[known] = np.arange(n)

    def places(self, ids: np.ndarray) -> np.ndarray:
        if self.direct:
            return self.place.take(ids.astype(np.int64), mode="clip")
        at = np.searchsorted(self.known[: self.n], ids)
        return np.where(self.known[at] == ids, at, self.n) if self.n else at


class _Model:
    """What all lanes of a block share, and the last ids of each.  Steps over all lanes multiply by hits where they
    could choose by them, which numpy is slow at."""

    def __init__(self, lanes: int, bits: int):
        self.t1, self.t2 = np.zeros(SLOTS1, np.uint32), np.zeros(SLOTS2, np.uint32)
        self.p1, self.p2, self.past = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint8)
        self.order0 = _Order0(bits)
        self.outcomes = np.tile([1.6, 0.2, 0.2], (512, 1))  # of each context: no guess held, the order-2 one, the order-1 one
        self.rows, self.missed, self.escaped, self.steps, self.due = [], [], 0, 0, 1
        self._weigh()

    def _seen(self) -> np.ndarray:
        return self.outcomes[:, :1] + self.outcomes[:, 1:2] + self.outcomes[:, 2:]  # in this order on every machine

    def _weigh(self) -> None:
        """Tables of a context's bounds, and of start and width by context and outcome; without a
        guess that held, the width is that of one of P0's steps."""
        share = self.outcomes / self._seen()
        most = TOTAL / TOTAL0
        unit = np.clip(np.rint(share[:, 0] * most), 1, most - 1)
        self.both = TOTAL - unit * TOTAL0
        self.first = np.clip(np.rint(self.both * (share[:, 1] / (share[:, 1] + share[:, 2]))), 64, self.both - 64)
        self.start = np.stack((self.both, 0 * unit, self.first, 0 * unit), axis=1).ravel()
        self.width = np.stack((unit, self.first, self.both - self.first, unit), axis=1).ravel()

    def predict(self, n: int) -> None:
        """Guesses and contexts of the first n lanes' next ids."""
        m = self.p1[:n] * np.uint32(2654435761)
        self.h1 = (m >> np.uint32(33 - SLOTS1.bit_length())).astype(np.int64)
        m = (m ^ self.p2[:n] * np.uint32(2246822519)) * np.uint32(3266489917)
        self.h2 = (m >> np.uint32(33 - SLOTS2.bit_length())).astype(np.int64)
        self.e1, self.e2 = self.t1[self.h1], self.t2[self.h2]
        self.g1, self.g2 = self.e1 & IDS, self.e2 & IDS
        self.s1, self.s2 = (self.e1 >> np.uint32(24)).astype(np.uint8), (self.e2 >> np.uint32(24)).astype(np.uint8)
        low = self.s1 << np.uint8(3) | self.past[:n] << np.uint8(1) | (self.g1 == self.g2).view(np.uint8)
        self.w = self.s2.astype(np.uint16) << np.uint16(6) | low.astype(np.uint16)

    def intervals(self, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width by outcome; hit1: the order-1 guess held where the order-2 guess did not."""
        outcome = hit2.view(np.uint8) | hit1.view(np.uint8) << np.uint8(1)
        self.row = (self.w << np.uint16(2) | outcome.astype(np.uint16)).astype(np.int64)
        return self.start.take(self.row, mode="clip"), self.width.take(self.row, mode="clip")

    def within0(self, miss: np.ndarray, k: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """Starts and widths of the lanes miss become those of P0's places k."""
        unit = width.take(miss, mode="clip")
        start[miss] += self.order0.start.take(k, mode="clip") * unit
        width[miss] = self.order0.freq.take(k, mode="clip") * unit

    def update(self, n: int, s: np.ndarray, hit2: np.ndarray, missed: np.ndarray, escaped: int) -> None:
        """missed: ids of the lanes where neither guess held."""
        short = s & IDS  # ids beyond 24 bits are never guessed
        hit = hit2.view(np.uint8)
        for t, h, sure, held in ((self.t1, self.h1, self.s1, (self.g1 == s).view(np.uint8)), (self.t2, self.h2, self.s2, hit)):
            t[h] = (np.minimum(sure + np.uint8(1), np.uint8(7)) * held).astype(np.uint32) << np.uint32(24) | short
        past = self.past[:n]
        past <<= np.uint8(1)
        past &= np.uint8(2)
        past |= hit
        self.p2[:n] = self.p1[:n]
        self.p1[:n] = s
        self.rows.append(self.row)
        self.missed.append(missed)
        self.escaped += escaped
        self.steps += 1
        if self.steps >= self.due:
            self.outcomes += np.bincount(np.concatenate(self.rows), minlength=2048).reshape(512, 4)[:, :3]
            self.outcomes *= np.minimum(1, MEMORY / self._seen())
            self._weigh()
            self.order0.learn(np.concatenate(self.missed), self.escaped)
            self.rows, self.missed, self.escaped = [], [], 0
            self.due = self.steps + max(1, min(self.steps // 8, REFRESH))


def _shape(count: int) -> tuple[int, int, int]:
    """Lanes of a block of count ids, ids of each but the last, and of the last."""
    steps = -(-count // max(1, min(LANES, count // STEPS)))
    lanes = -(-count // steps)
    return lanes, steps, count - (lanes - 1) * steps


def _encode_block(ids: np.ndarray, widths: list[int]) -> np.ndarray:
    lanes, steps, last = _shape(len(ids))
    grid = np.zeros(lanes * steps, np.uint32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(lanes, sum(widths))
    low, rng = np.zeros(lanes), np.full(lanes, WORD * WORD)
    words, owners = [], []

    def settle(small: np.ndarray) -> None:
        """A word of each of these lanes leaves; a carry leaves with it, as its 25th bit."""
        x = low.take(small, mode="clip")
        word = np.floor(x * (1 / WORD))
        words.append(word.astype(np.uint32))
        owners.append(small.astype(np.uint16))
        low[small] = (x - word * WORD) * WORD
        rng[small] *= WORD

    for step in range(steps):
        n = lanes if step < last else lanes - 1
        s = grid[step, :n]
        model.predict(n)
        hit2 = model.g2 == s
        hit1 = (model.g1 == s) & ~hit2
        start, width = model.intervals(hit2, hit1)
        miss = np.flatnonzero(~(hit2 | hit1))
        ms = s.take(miss, mode="clip")
        k = model.order0.places(ms)
        model.within0(miss, k, start, width)
        r = np.floor(rng[:n] * (1 / TOTAL))
        low[:n] += r * start
        rng[:n] = r = r * width
        settle(np.flatnonzero(r < LEAST))
        escaped = k == model.order0.n
        if escaped.any():
            which, left = miss[escaped], sum(widths)
            for bits in widths:
                left -= bits
                r = np.floor(rng[which] * 2.0**-bits)
                low[which] += r * (ms[escaped] >> np.uint32(left) & np.uint32((1 << bits) - 1))
                rng[which] = r
                settle(which[r < LEAST])
        model.update(n, s, hit2, ms, np.count_nonzero(escaped))
    return _in_reading_order(low, words, owners)


def _in_reading_order(low: np.ndarray, words: list[np.ndarray], owners: list[np.ndarray]) -> np.ndarray:
    """24-bit words in the order in which the decoder reads them: two of each lane, and then one
    wherever a lane put one out, which is the lane's next but one."""
    lanes = len(low)
    top = np.floor(low * (1 / WORD))
    every, events = np.arange(lanes, dtype=np.uint16), sum(map(len, words))
    words = np.concatenate([*words, top.astype(np.uint32), (low - top * WORD).astype(np.uint32)])
    owner = np.concatenate([*owners, every, every])
    order = np.argsort(owner, kind="stable")
    words = words[order]
    while len(big := np.flatnonzero(words >> np.uint32(24))):
        words[big] -= np.uint32(1 << 24)
        words[big - 1] += np.uint32(1)
    begin = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=lanes))))[:-1]
    out = np.empty(len(words), np.uint32)
    out[:lanes], out[lanes : 2 * lanes] = words[begin], words[begin + 1]
    at = np.flatnonzero(order < events)
    out[2 * lanes + order[at]] = words[at + 2]
    return out


def encode(ids: np.ndarray, block: int, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit words of all blocks one after the other, words of each block)."""
    parts = []
    for at in range(0, len(ids), block):
        raw = _encode_block(ids[at : at + block], widths).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        parts.append(np.frombuffer(raw + b"\0" * (len(raw) % 2), "<u2"))
    return np.concatenate(parts), np.array([len(p) for p in parts], np.uint32)


def _decode_block(data: bytes, count: int, widths: list[int]) -> np.ndarray:
    lanes, steps, last = _shape(count)
    planes = np.frombuffer(data, np.uint8, len(data) // 3 * 3).reshape(-1, 3).astype(np.float64)
    words = planes[:, 0] + planes[:, 1] * 2.0**8 + planes[:, 2] * 2.0**16
    at = 2 * lanes
    if len(words) < at:
        raise ValueError("too short")
    code, rng = words[:lanes] * WORD + words[lanes:at], np.full(lanes, WORD * WORD)
    model = _Model(lanes, sum(widths))
    grid = np.zeros((steps, lanes), np.uint32)

    def settle(small: np.ndarray) -> None:
        nonlocal at
        if at + len(small) > len(words):
            raise ValueError("too short")
        code[small] = code.take(small, mode="clip") * WORD + words[at : at + len(small)]
        rng[small] *= WORD
        at += len(small)

    for step in range(steps):
        n = lanes if step < last else lanes - 1
        model.predict(n)
        r = np.floor(rng[:n] * (1 / TOTAL))
        t = np.minimum(np.floor(code[:n] / r), TOTAL - 1)
        w = model.w.astype(np.int64)
        hit2, missed = t < model.first.take(w, mode="clip"), t >= model.both.take(w, mode="clip")
        s = model.g1 + (model.g2 - model.g1) * hit2.astype(np.uint32)
        start, width = model.intervals(hit2, ~(hit2 | missed))
        miss = np.flatnonzero(missed)
        slot = (t.take(miss, mode="clip") - start.take(miss, mode="clip")) / width.take(miss, mode="clip")
        k = model.order0.look.take(slot.astype(np.int64), mode="clip")
        ms = model.order0.known.take(k, mode="clip")
        model.within0(miss, k, start, width)
        code[:n] -= r * start
        rng[:n] = r = r * width
        settle(np.flatnonzero(r < LEAST))
        escaped = k == model.order0.n
        if escaped.any():
            which = miss[escaped]
            found = np.zeros(len(which), np.uint32)
            for bits in widths:
                r = np.floor(rng[which] * 2.0**-bits)
                digit = np.minimum(np.floor(code[which] / r), 2.0**bits - 1)
                code[which] -= r * digit
                rng[which] = r
                found = found << np.uint32(bits) | digit.astype(np.uint32)
                settle(which[r < LEAST])
            ms[escaped] = found
        s[miss] = ms
        grid[step, :n] = s
        model.update(n, s, hit2, ms, np.count_nonzero(escaped))
    return np.ascontiguousarray(grid.T).reshape(-1)[:count]


def decode(words: np.ndarray, sizes: np.ndarray, count: int, block: int, widths: list[int]) -> np.ndarray:
    out, at = [], 0
    for k, size in enumerate(sizes.tolist()):
        try:
            out.append(_decode_block(words[at : at + size].astype("<u2").tobytes(), min(block, count - k * block), widths))
        except ValueError as e:
            raise ValueError(f"damaged block {k}") from e
        at += size
    return np.concatenate(out)


def pack_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A whole file: documents (ids and token counts), their token ids one after the other."""
    n, top = len(ids), int(ids.max()) if len(ids) else 0
    if n:
        words, sizes = encode(ids, block, widths_of(top))
        sums = np.array([zlib.crc32(ids[i : i + block].astype("<u4").tobytes()) for i in range(0, n, block)], np.uint32)
    else:
        sizes = sums = np.zeros(0, np.uint32)
        words = np.zeros(0, "<u2")
    head = zlib.compress(b"".join((
        struct.pack("<QQII", len(doc_ids), n, block, top), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(lengths, "<u4").tobytes(), sizes.astype("<u4").tobytes(), sums.astype("<u4").tobytes(),
    )), 6)
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + words.tobytes()


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, token ids); ValueError if anything is damaged."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of this format")
    size, crc = struct.unpack_from("<II", data, 8)
    if zlib.crc32(data[16 : 16 + size]) != crc:
        raise ValueError("damaged header")
    head = zlib.decompress(data[16 : 16 + size])
    docs, n, block, top = struct.unpack_from("<QQII", head)
    blocks, at = -(-n // block), 24

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(head, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, lengths, sizes, sums = take(docs, "<i8"), take(docs, "<u4"), take(blocks, "<u4"), take(blocks, "<u4")
    if not n:
        return doc_ids, lengths, np.zeros(0, np.uint32)
    ids = decode(np.frombuffer(data, "<u2", offset=16 + size), sizes, n, block, widths_of(top))
    for k in range(blocks):
        if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) != sums[k]:
            raise ValueError(f"damaged block {k}")
    return doc_ids, lengths, ids
