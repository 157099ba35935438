"""Harmonic packing of token sequences.

With capacity C, class k holds pieces of which exactly k fill one bin: lengths in
(C/(k+1), C/k].  A document is cut greedily: whole bins first (class 1), then the
largest reciprocal size C//k that its rest still has, down to ``tail`` tokens,
and the last rest goes to its class as it is.  Each worker fills the bins of each
class on its own with a fixed count of pieces, so there is no shuffle and no
exchange of state; nothing but the open bin of every class is held.  What is left in
open bins when a worker's rows end is merged first-fit, longest piece first.

Bins with reciprocal sizes waste C mod k tokens, those of rests at most C/(k+1).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, small_batches
from .words import word_table

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long"
FLUSH_BYTES = 8 << 20


def cuts(n: int, capacity: int, tail: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document with n tokens."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest > tail:
        k = capacity // (rest + 1) + 1  # the least k with capacity // k <= rest
        size = capacity // k
        out.append((size, k))
        rest -= size
    if rest:
        out.append((rest, capacity // rest))
    return out


class HarmonicPacker:
    """One worker's open bins.  A bin is the list of its pieces (doc, start, ids, doc tokens)."""

    def __init__(self, capacity: int, tail: int):
        self.capacity, self.tail, self.open = capacity, tail, {}

    def add(self, doc: int, ids: bytes) -> Iterator[list[tuple]]:
        n, at = len(ids) // 4, 0
        for length, k in cuts(n, self.capacity, self.tail):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, at, ids[4 * at : 4 * (at + length)], n))
            at += length
            if len(bin_) == k:
                yield self.open.pop(k)

    def rest(self) -> Iterator[list[tuple]]:
        bins: list[list] = []
        room: list[int] = []
        for piece in sorted((p for b in self.open.values() for p in b), key=lambda p: (-len(p[2]), p[0], p[1])):
            n = len(piece[2]) // 4
            i = next((i for i, r in enumerate(room) if r >= n), None)
            if i is None:
                bins.append([])
                room.append(self.capacity)
                i = len(bins) - 1
            bins[i].append(piece)
            room[i] -= n
        self.open = {}
        yield from bins


def padded(tokens: int, capacity: int) -> int:
    """Sequences are padded to the capacity, but a power of two stands as it is."""
    return tokens if tokens & (tokens - 1) == 0 else capacity


def pack_rows(rows: Iterable[tuple[int, bytes]], base: int, capacity: int, tail: int) -> Iterator[pa.RecordBatch]:
    packer, number, size = HarmonicPacker(capacity, tail), base, 0
    cols: list[list] = [[] for _ in range(9)]

    def put(pieces: list[tuple]) -> None:
        nonlocal number, size
        total, at = sum(len(p[2]) for p in pieces) // 4, 0
        for doc, start, ids, n in pieces:
            for c, v in zip(cols, (doc, start, len(ids) // 4, ids, n, number, at, total, padded(total, capacity)), strict=True):
                c.append(v)
            at += len(ids) // 4
            size += len(ids)
        number += 1

    def batch() -> pa.RecordBatch:
        nonlocal cols, size
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names=[c.split()[0] for c in PIECES.split(", ")])
        cols, size = [[] for _ in range(9)], 0
        return out

    for doc, ids in rows:
        for pieces in packer.add(doc, ids):
            put(pieces)
            if size >= FLUSH_BYTES:
                yield batch()
    for pieces in packer.rest():
        put(pieces)
    if cols[0]:
        yield batch()


def harmonic_packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, tail: int = 63, end_id: int = 1) -> DataFrame:
    """Pack all rows' token ids, each text closed by end_id, into sequences of at most
    capacity tokens; one row per piece, whose ids are little-endian unsigned 32-bit.

    Null and empty texts have the end id alone.  Repeated rows are packed as often
    as they occur.  Rows with a null id are left out.  An empty table gives no pieces.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        table = word_table(tokenizer)

        def rows():
            for b in batches:
                ids = b.column(0).to_pylist()
                for doc, x in zip(ids, table.encode_batch(b.column(1).to_pylist()), strict=True):
                    yield doc, x + end

        yield from pack_rows(rows(), TaskContext.get().partitionId() << 33, capacity, tail)

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)
