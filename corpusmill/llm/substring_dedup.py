"""Removal of repeated byte strings by suffix sorting.

A window is a string of ``width`` bytes within one text.  A byte goes if a window that covers
it also starts in a text with a smaller id.

1. Every window has a minimiser, the least hash of its ``gram``-byte strings, and neighbouring
   windows with the same one form a piece.  Equal windows have equal minimisers, so only
   pieces whose minimiser is in two texts can matter.  A block of texts keeps its texts in
   a file in the shared folder, learns which of them are equal (by 128-bit hashes) to one with
   a smaller id, whose windows say nothing new, and asks for the other texts'
   minimisers, each once, in packed messages to the shards that count them.
2. With the answers each block cuts the pieces that matter out of its texts and sends each
   different piece once, with the least id that has it, to the shard of its minimiser.
   Minimisers in very many texts are dealt out window by window instead, by the
   windows' own hashes, so that no passage, however common, makes a shard large.
3. A shard concatenates its pieces, sorts their suffixes in two stages (suffixes.py), takes
   adjacent common prefixes, and finds the least id of each class of equal windows.  It
   answers each block with the bytes of each piece that a smaller id has.
4. Each block merges the answers into maximal removed runs.

What a block sends or gets in one message is a share of its own texts, and nothing is dropped:
a minimiser's hash only decides where windows meet; bytes decide what is equal.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import atomic_output, id_text, live_with, open_store, rows_of, shared_dir, small_batches, tasks
from .suffixes import adjacent_prefixes, suffix_array, words8

U = np.uint64
FP_BITS = 40
_MESSAGE = "block long, shard int, data binary"
_NAMES = ["block", "shard", "data"]


def _message(block: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=_NAMES)


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(np.asarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, count: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count).T
    return out.view("<u8").reshape(-1)


# ---------------------------------------------------------------- minimisers


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each position on, built up by doubling."""
    a = 0x9E3779B97F4A7C15
    power = lambda k: U(pow(a, k, 1 << 64))
    size, h, out, done = 1, text.astype(np.uint64) + U(1), None, 0
    while True:
        if gram & size:
            if out is None:
                out = h
            else:
                n = len(h) - done
                out = out[:n] * power(size) + h[done : done + n]
            done += size
        if done == gram:
            break
        h = h[:-size] * power(size) + h[size:]
        size *= 2
    out = (out ^ (out >> U(32))) * U(0xD6E8FEB86659FD93)
    return out ^ (out >> U(29))


def sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    size = 1
    while 2 * size <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (span - size)], h[span - size :]) if span > size else h


def pieces(text: np.ndarray, edges: np.ndarray, width: int, gram: int, stride: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of the pieces of texts that follow each other in
    text; edges are their starts and the end."""
    span, n = width - gram + 1, len(text)
    firsts, counts, marks = [], [], []
    ends = np.sort(edges[1:])
    for lo in range(0, max(0, n - width + 1), stride):
        hi = min(n - width + 1, lo + stride)  # windows lo..hi
        v = sliding_min(gram_hashes(text[lo : hi + width - 1], gram), span)
        valid = np.ones(hi - lo, bool)
        for e in ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, hi + width - 1)].tolist():
            valid[max(0, e - width + 1 - lo) : max(0, e - lo)] = False
        change = np.ones(hi - lo, bool)
        change[1:] = (v[1:] != v[:-1]) | ~valid[:-1]
        start = np.flatnonzero(valid & change)
        stop = np.flatnonzero(valid & np.concatenate((change[1:] | ~valid[1:], [True]))) + 1
        firsts.append(start + lo)
        counts.append(stop - start)
        marks.append(v[start] >> U(64 - FP_BITS))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(marks)


class Block:
    """Texts of a block: ids, concatenated bytes and their edges."""

    def __init__(self, ids: np.ndarray, data: bytes, edges: np.ndarray):
        self.ids, self.data, self.edges = ids, data, edges
        self.text = np.frombuffer(data, np.uint8)

    @classmethod
    def of(cls, ids: list[int], texts: list[bytes]) -> Block:
        return cls(np.array(ids, np.int64), b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))

    def pack(self) -> bytes:
        return zstandard.compress(struct.pack("<I", len(self.ids)) + self.ids.astype("<i8").tobytes() + self.edges.astype("<i8").tobytes() + self.data, 3)

    @classmethod
    def unpack(cls, packed: bytes) -> Block:
        raw = zstandard.decompress(packed)
        n = struct.unpack_from("<I", raw)[0]
        return cls(np.frombuffer(raw, "<i8", n, 4), raw[12 + 16 * n :], np.frombuffer(raw, "<i8", n + 1, 4 + 8 * n))

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, positions, "right") - 1


def _load(store, path: str) -> bytes:
    with store.open_input_file(path) as f:
        return f.read()


def _save(store, path: str, data: bytes) -> None:
    with atomic_output(store, path) as out:
        out.write(data)


def _distinct_marks(block: Block, copies: bytes, width: int, gram: int):
    """The pieces of the block's texts but copies, their sorted distinct minimisers, and in how
    many ids each is (up to 255)."""
    first, count, mark = pieces(block.text, block.edges, width, gram)
    own = np.frombuffer(copies, np.uint8)[block.doc_of(first)] == 0 if len(first) else np.zeros(0, bool)
    first, count, mark = first[own], count[own], mark[own]
    rank = np.unique(block.ids, return_inverse=True)[1].astype(np.uint64)  # rows with the same id are one text's
    pair = np.sort((mark << U(24)) | rank[block.doc_of(first)]) if len(first) else mark
    if len(pair):
        pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))]
    of = pair >> U(24)
    lead = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    return first, count, mark, of[lead], np.minimum(np.diff(np.append(lead, len(of))), 255)


def _ask_copies(folder: str, shards: int, block_bytes: int):
    """Write the blocks; ask who has the least id of each text."""

    def run(batches: Iterable[pa.RecordBatch]):
        store, root = open_store(folder)
        number = TaskContext.get().partitionId() << 24
        ids, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            _save(store, f"{root}/{number}.txt", Block.of(ids, texts).pack())
            parts: dict[int, list[bytes]] = {}
            for doc, t in zip(ids, texts, strict=True):
                h = xxhash.xxh3_128_digest(t)
                parts.setdefault(int.from_bytes(h[:4], "little") % shards, []).append(h + struct.pack("<q", doc))
            return _message(number, [(k, b"".join(x)) for k, x in sorted(parts.items())])

        for doc, text in rows_of(batches):
            ids.append(doc)
            texts.append(text.encode())
            held += len(texts[-1])
            if held >= block_bytes or len(ids) >= 1 << 20:
                yield flush()
                ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield flush()

    return run


def _find_copies(asked: pa.Table) -> pa.Table:
    """For each text of each message, whether an equal one has a smaller id."""
    messages = [[(x[i : i + 16], struct.unpack_from("<q", x, i + 16)[0]) for i in range(0, len(x), 24)] for x in asked.column(2).to_pylist()]
    least: dict[bytes, int] = {}
    for h, doc in (e for m in messages for e in m):
        if h not in least or doc < least[h]:
            least[h] = doc
    return pa.table([asked.column(0), asked.column(1), pa.array([bytes(doc > least[h] for h, doc in m) for m in messages], pa.binary())], names=_NAMES)


def _ask_marks(folder: str, shards: int, copy_shards: int, width: int, gram: int):
    """Ask for the minimisers of the texts that are no copies."""

    def run(answers: pa.Table) -> pa.Table:
        store, root = open_store(folder)
        number = answers.column(0)[0].as_py()
        block = Block.unpack(_load(store, f"{root}/{number}.txt"))
        given = {k: iter(x) for k, x in zip(answers.column(1).to_pylist(), answers.column(2).to_pylist(), strict=True)}
        copies = bytes(next(given[int.from_bytes(xxhash.xxh3_128_digest(block.data[a:b])[:4], "little") % copy_shards]) for a, b in zip(block.edges[:-1].tolist(), block.edges[1:].tolist(), strict=True))
        _save(store, f"{root}/{number}.cpy", copies)
        _, _, _, marks, docs = _distinct_marks(block, copies, width, gram)
        cut = np.searchsorted(marks, (np.arange(shards + 1, dtype=np.uint64) << U(FP_BITS)) // U(shards))
        rows = []
        for k in range(shards):
            m = marks[cut[k] : cut[k + 1]]
            if len(m):
                step = np.diff(np.concatenate((np.zeros(1, np.uint64), m)))
                rows.append((k, zstandard.compress(struct.pack("<I", len(m)) + _planes(step, 5) + docs[cut[k] : cut[k + 1]].astype(np.uint8).tobytes(), 1)))
        return pa.Table.from_batches([_message(number, rows or [(number % shards, zstandard.compress(struct.pack("<I", 0), 1))])])

    return run


def _count(hot: int):
    """Answers 0 for a minimiser in one text, 1 in several, 2 in at least hot, in order of each question."""

    def run(asked: pa.Table) -> pa.Table:
        marks, docs, sizes = [], [], []
        for data in asked.column(2).to_pylist():
            raw = zstandard.decompress(data)
            n = struct.unpack_from("<I", raw)[0]
            marks.append(np.cumsum(_unplanes(raw, n, 5, 4), dtype=np.uint64))
            docs.append(np.frombuffer(raw, np.uint8, n, 4 + 5 * n).astype(np.int64))
            sizes.append(n)
        every, each = np.concatenate(marks), np.concatenate(docs)
        order = np.argsort(every, kind="stable")
        s = every[order]
        group = np.cumsum(np.concatenate(([False], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        total = np.bincount(group, each[order]) if len(s) else np.zeros(0)
        status = np.zeros(len(s), np.uint8)
        status[order] = np.where(total[group] >= hot, 2, np.where(total[group] > 1, 1, 0))
        out, at = [], 0
        for n in sizes:
            part = status[at : at + n]
            out.append(zstandard.compress(struct.pack("<I", n) + np.packbits(part > 0).tobytes() + np.packbits(part > 1).tobytes(), 1))
            at += n
        return pa.table([asked.column(0), asked.column(1), pa.array(out, pa.binary())], names=_NAMES)

    return run


def _cut_pieces(folder: str, shards: int, width: int, gram: int):
    """Send the block's pieces that matter; where they stand goes to a file."""

    def run(answers: pa.Table) -> pa.Table:
        store, root = open_store(folder)
        number = answers.column(0)[0].as_py()
        block = Block.unpack(_load(store, f"{root}/{number}.txt"))
        first, count, mark, marks, _ = _distinct_marks(block, _load(store, f"{root}/{number}.cpy"), width, gram)
        status = []
        for _, data in sorted(zip(answers.column(1).to_pylist(), answers.column(2).to_pylist(), strict=True)):
            raw = zstandard.decompress(data)
            n = struct.unpack_from("<I", raw)[0]
            bits = lambda at: np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n)  # noqa: B023, E731
            status.append(bits(4) + bits(4 + -(-n // 8)))
        status = np.concatenate(status) if status else np.zeros(0, np.uint8)
        own = status[np.searchsorted(marks, mark)] if len(mark) else np.zeros(0, np.uint8)
        rows = np.flatnonzero(own)
        doc = block.doc_of(first[rows])
        place: dict[bytes, int] = {}
        least: list[int] = []
        shard: list[int] = []
        sub: list[int] = []
        what, where, whose = [], [], []
        data, ids = block.data, block.ids.tolist()
        fine = mark[rows] * U(shards) >> U(FP_BITS - 8)  # shard, and one of 256 parts of it
        deal = fine.tolist()
        for f, c, s, d, k in zip(first[rows].tolist(), count[rows].tolist(), own[rows].tolist(), doc.tolist(), deal, strict=True):
            for lo, hi in ((f, f + c + width - 1),) if s == 1 else ((i, i + width) for i in range(f, f + c)):
                piece = data[lo:hi]
                i = place.get(piece)
                if i is None:
                    i = place[piece] = len(least)
                    least.append(ids[d])
                    k = k if s == 1 else (h := zlib.crc32(piece)) % shards << 8 | h >> 24
                    shard.append(k >> 8)
                    sub.append(k & 255)
                elif ids[d] < least[i]:
                    least[i] = ids[d]
                what.append(i)
                where.append(lo)
                whose.append(d)
        by: dict[int, list[int]] = {}
        names = list(place)
        for i, k in enumerate(shard):
            by.setdefault(k, []).append(i)
        order = [i for k in sorted(by) for i in by[k]]
        n, m = len(names), len(what)
        # where pieces stand: sorted by position, so that the file packs well
        what, where, whose = np.array(what, np.int64), np.array(where, np.int64), np.array(whose, np.int64)
        _save(store, f"{root}/{number}.pos", zstandard.compress(
            struct.pack("<II", n, m) + _planes(np.array(order, np.uint64), 4) + np.array([len(p) for p in names], "<u4").tobytes() + np.array(least, "<i8").tobytes()
            + _planes(what.astype(np.uint64), 4) + _planes(np.diff(where, prepend=0).astype(np.int64).view(np.uint64), 8) + _planes(whose.astype(np.uint64), 4), 3))
        out = []
        for k in sorted(by):
            mine = by[k]
            out.append((k, zstandard.compress(struct.pack("<I", len(mine)) + np.array([len(names[i]) for i in mine], "<u4").tobytes() + np.array([least[i] for i in mine], "<i8").tobytes() + bytes(sub[i] for i in mine) + b"".join(names[i] for i in mine), 1)))
        return pa.Table.from_batches([_message(number, out or [(number % shards, zstandard.compress(struct.pack("<I", 0), 1))])])

    return run


def repeated_windows(text: np.ndarray, lengths: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Mask of the windows (by first byte) of pieces that follow each other in text which
    also stand in a piece with a smaller owner."""
    out = np.zeros(len(text), bool)
    window = np.ones(len(text), bool)
    ends = np.cumsum(lengths)
    for k in range(1, width):  # no window starts in the last bytes of a piece
        window[ends[lengths >= k] - k] = False
    keys = words8(text)
    sa = suffix_array(text, depth=-(-width // 8) * 8, wanted=window, keys=keys)
    if len(sa):
        same = adjacent_prefixes(keys, sa, width) >= width
        lead = np.flatnonzero(~same)
        mine = owner[np.searchsorted(ends, sa, "right")]
        least = np.minimum.reduceat(mine, lead)[np.cumsum(~same) - 1]
        out[sa[least < mine]] = True
    return out


def covered_runs(pieces_: list[bytes], owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of the runs of bytes in windows that smaller owners have, in order."""
    lengths = np.array([len(p) for p in pieces_], np.int64)
    base = np.concatenate(([0], np.cumsum(lengths)))
    n = int(base[-1])
    gone = np.flatnonzero(repeated_windows(np.frombuffer(b"".join(pieces_), np.uint8), lengths, owner, width))
    mark = np.zeros(n + 1, np.int32)
    mark[gone] += 1
    mark[gone + width] -= 1  # windows of one piece end at different bytes, and never beyond it
    covered = np.concatenate((np.cumsum(mark)[:-1] > 0, [False]))
    before = np.concatenate(([False], covered[:-1]))
    before[base] = False  # runs end with their piece
    begin = np.flatnonzero(covered & ~before)
    stop = covered.copy()
    stop[:-1] &= ~covered[1:]
    stop[base[1:][lengths > 0] - 1] |= covered[base[1:][lengths > 0] - 1]
    end = np.flatnonzero(stop) + 1
    of = np.searchsorted(base, begin, "right") - 1
    return of, begin - base[of], end - base[of]


#: Bytes of pieces that are sorted at a time; a shard's parts are put together up to it.
SORT_BYTES = 1_500_000


def _sort_shard(width: int):
    """For each message, the byte ranges of each of its pieces that smaller ids have."""

    def run(sent: pa.Table) -> pa.Table:
        sizes, owners, which, least, part = [], [], [], [], []
        place: dict[bytes, int] = {}  # equal pieces of several blocks are sorted once, under their least id
        for packed in sent.column(2).to_pylist():
            raw = zstandard.decompress(packed)
            n = struct.unpack_from("<I", raw)[0]
            sizes.append(n)
            ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)) + 4 + 13 * n
            owner = np.frombuffer(raw, "<i8", n, 4 + 4 * n)
            owners.append(owner)
            at = 4 + 13 * n
            for end, o, k in zip(ends.tolist(), owner.tolist(), raw[4 + 12 * n : at], strict=True):
                piece = raw[at:end]
                at = end
                i = place.setdefault(piece, len(least))
                if i == len(least):
                    least.append(o)
                    part.append(k)
                elif o < least[i]:
                    least[i] = o
                which.append(i)
        names, least, which = list(place), np.array(least, np.int64), np.array(which, np.int64)
        place.clear()
        plen = np.array([len(p) for p in names], np.int64)
        order = np.argsort(np.array(part, np.uint8), kind="stable")
        volume, begin = np.bincount(np.array(part, np.int64), plen, 256), np.searchsorted(np.array(part, np.uint8)[order], np.arange(257))
        found, lo = [], 0
        while lo < 256:  # equal windows are in the same part
            hi = lo + 1
            while hi < 256 and volume[lo : hi + 1].sum() <= SORT_BYTES:
                hi += 1
            rows = order[begin[lo] : begin[hi]]
            if len(rows):
                of, a, b = covered_runs([names[i] for i in rows.tolist()], least[rows], width)
                found.append((rows[of], a, b))
            lo = hi
        of, start, stop = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(of, kind="stable")
        of, start, stop = of[order], start[order], stop[order]
        runs_at = np.searchsorted(of, np.arange(len(names) + 1))
        out, at = [], 0
        for n, owner in zip(sizes, owners, strict=True):
            w = which[at : at + n]
            at += n
            whole = least[w] < owner  # a smaller id of another block has the whole piece
            first, count = runs_at[w], np.where(whole, 0, runs_at[w + 1] - runs_at[w])
            take = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            at_piece = np.cumsum(count + whole) - count - whole
            a, b = np.zeros(int((count + whole).sum()), np.int64), np.zeros(int((count + whole).sum()), np.int64)
            b[at_piece[whole]] = plen[w[whole]]
            free = np.ones(len(a), bool)
            free[at_piece[whole]] = False
            a[free], b[free] = start[take], stop[take]
            out.append(zstandard.compress(struct.pack("<II", n, len(a)) + (count + whole).astype("<u4").tobytes() + a.astype("<u4").tobytes() + b.astype("<u4").tobytes(), 1))
        return pa.table([sent.column(0), sent.column(1), pa.array(out, pa.binary())], names=_NAMES)

    return run


RESULT = "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge(folder: str, width: int, whole_chars: bool):
    def run(answers: pa.Table) -> pa.Table:
        store, root = open_store(folder)
        number = answers.column(0)[0].as_py()
        block = Block.unpack(_load(store, f"{root}/{number}.txt"))
        raw = zstandard.decompress(_load(store, f"{root}/{number}.pos"))
        n, m = struct.unpack_from("<II", raw)
        at = 8
        order = _unplanes(raw, n, 4, at).astype(np.int64)
        plen = np.frombuffer(raw, "<u4", n, at := at + 4 * n).astype(np.int64)
        least = np.frombuffer(raw, "<i8", n, at := at + 4 * n)
        what = _unplanes(raw, m, 4, at := at + 8 * n).astype(np.int64)
        where = np.cumsum(_unplanes(raw, m, 8, at := at + 4 * m).view(np.int64))
        whose = _unplanes(raw, m, 4, at + 8 * m).astype(np.int64)
        counts, start, stop = [], [], []
        for _, data in sorted(zip(answers.column(1).to_pylist(), answers.column(2).to_pylist(), strict=True)):
            a = zstandard.decompress(data)
            k, r = struct.unpack_from("<II", a)
            counts.append(np.frombuffer(a, "<u4", k, 8))
            start.append(np.frombuffer(a, "<u4", r, 8 + 4 * k))
            stop.append(np.frombuffer(a, "<u4", r, 8 + 4 * k + 4 * r))
        counts, start, stop = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (counts, start, stop))
        mark = np.zeros(len(block.text) + 1, np.int32)
        if m:
            number_of, from_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
            number_of[order], from_[order] = counts, np.cumsum(counts) - counts
            # a text with an id over the least of its own block loses the whole piece
            later = block.ids[whose] > least[what]
            np.add.at(mark, where[later], 1)
            np.add.at(mark, (where + plen[what])[later], -1)
            w, p = what[~later], where[~later]
            reps = number_of[w]
            run_of = np.repeat(from_[w] - np.cumsum(reps) + reps, reps) + np.arange(int(reps.sum()))
            p = np.repeat(p, reps)
            np.add.at(mark, p + start[run_of], 1)
            np.add.at(mark, p + stop[run_of], -1)
        for d in np.flatnonzero(np.frombuffer(_load(store, f"{root}/{number}.cpy"), np.uint8)).tolist():
            if block.edges[d + 1] - block.edges[d] >= width:  # a copy of a smaller id's text goes as a whole
                mark[block.edges[d]] += 1
                mark[block.edges[d + 1]] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        ids, sizes, removed, spans, kept = block.ids.tolist(), [], [], [], []
        edges = block.edges.tolist()
        for lo, hi in zip(edges, edges[1:], strict=False):
            g = gone[lo:hi]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
            text = block.data[lo:hi]
            pairs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            if whole_chars:
                pairs = [(a, b) for a, b in (char_bounds(text, a, b) for a, b in pairs) if a < b]
            parts, done = [], 0
            for a, b in pairs:
                parts.append(text[done:a])
                done = b
            parts.append(text[done:])
            sizes.append(hi - lo)
            removed.append(sum(b - a for a, b in pairs))
            spans.append([{"start": a, "end": b} for a, b in pairs])
            kept.append(b"".join(parts))
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPAN), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def char_bounds(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The largest range of whole UTF-8 characters in a..b."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 50, gram: int = 20, hot: int = 16384, block_bytes: int = 4_000_000, whole_chars: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, spans (maximal removed runs), kept (the
    remaining bytes, joined).

    Null text is empty; texts under width bytes lose nothing; rows with the same id are
    judged alike and never against each other; rows with a null id are left out; an
    empty table gives an empty result.  whole_chars shrinks each run to whole UTF-8
    characters, so that what is kept is text again.  gram, hot and block_bytes change no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "repeats")
    store, root = open_store(folder)
    store.create_dir(root)
    shards = 4 * tasks(spark)
    dealt = lambda df, key: df.repartition(tasks(spark), key).groupBy(key)  # noqa: E731  packed rows are small and costly, so partitions are not joined by size
    written = id_text(docs, id_col, text_col).mapInArrow(_ask_copies(folder, tasks(spark), block_bytes), _MESSAGE)
    copies = dealt(written, "shard").applyInArrow(_find_copies, _MESSAGE)
    asked = dealt(copies, "block").applyInArrow(_ask_marks(folder, shards, tasks(spark), width, gram), _MESSAGE)
    counted = dealt(asked, "shard").applyInArrow(_count(hot), _MESSAGE)
    sent = dealt(counted, "block").applyInArrow(_cut_pieces(folder, shards, width, gram), _MESSAGE)
    judged = dealt(sent, "shard").applyInArrow(_sort_shard(width), _MESSAGE)
    return live_with(dealt(judged, "block").applyInArrow(_merge(folder, width, whole_chars), RESULT), folder)
