"""Exact deduplication by an extendible-hash index on shared files.

1. Map tasks normalise each text (A-Z to lower case), hash it to 64 bits and,
   within a chunk of rows, join rows whose key *and bytes* agree to one
   representative.  A group with a third of all rows thus reaches its owner as
   one row per chunk, never as one row per copy.
2. Representatives are dealt by range of the key to owner tasks.  Each owner
   writes one index file to the shared folder: a heap with the texts, bucket
   pages of fixed entries, and a directory over the key's low bits that doubles
   when an overfull bucket must split.  Entries whose whole keys agree cannot be
   split and chain in their bucket.
3. The owner reads its file back, walks the buckets and compares the bytes of
   chained entries, so that a collision of keys never joins different texts.
4. Each chunk's rows take the verdict of their representative by an equi-join;
   no key of that join has more rows than a chunk.

An owner's file is written under a temporary name and renamed when whole.  A retried owner may
meet its entries in another order and so write other bytes; its classes and verdicts are
the same, and only the task that wrote a file reads it.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import atomic_output, id_text, live_with, open_store, shared_dir, small_batches, stored, tasks

ENTRY = struct.Struct("<QqqqqQI")  # key, representative, best id, best row, rows, heap offset, heap length
HEAD = struct.Struct("<QQIIH")  # directory offset, pages offset, buckets, entries, global depth


class ExtendibleHash:
    """Directory, buckets and splits; entries are tuples whose first item is the key."""

    def __init__(self, capacity: int = 256, max_depth: int = 40):
        self.capacity, self.max_depth, self.depth = capacity, max_depth, 0
        self.directory: list[list] = [[0, []]]  # each bucket: local depth, entries

    def insert(self, entry: tuple) -> None:
        key = entry[0]
        bucket = self.directory[key & ((1 << self.depth) - 1)]
        bucket[1].append(entry)
        while len(bucket[1]) > self.capacity and bucket[0] < self.max_depth and any(e[0] != key for e in bucket[1]):
            self._split(bucket)
            bucket = self.directory[key & ((1 << self.depth) - 1)]

    def _split(self, bucket: list) -> None:
        local, entries = bucket
        if local == self.depth:
            self.directory = self.directory + self.directory
            self.depth += 1
        bit = 1 << local
        bucket[0], bucket[1] = local + 1, [e for e in entries if not e[0] & bit]
        other = [local + 1, [e for e in entries if e[0] & bit]]
        first = next(i for i in range(bit) if self.directory[i] is bucket)
        for i in range(first + bit, len(self.directory), 2 * bit):
            self.directory[i] = other

    def buckets(self) -> list[list]:
        return list({id(b): b for b in self.directory}.values())


def write_index(store, path: str, entries: Iterator[tuple[tuple, bytes]], capacity: int) -> None:
    """Stream the compressed texts to the heap and insert the entries; pages and directory follow."""
    index = ExtendibleHash(capacity)
    with atomic_output(store, path) as out:
        at = n = 0
        for entry, data in entries:
            out.write(data)
            index.insert((*entry, at, len(data)))
            at, n = at + len(data), n + 1
        buckets, pages = index.buckets(), at
        number = {id(b): i for i, b in enumerate(buckets)}
        for local, held in buckets:
            page = struct.pack("<BI", local, len(held)) + b"".join(ENTRY.pack(*e) for e in held)
            out.write(page)
            at += len(page)
        out.write(struct.pack(f"<{len(index.directory)}I", *(number[id(b)] for b in index.directory)))
        out.write(HEAD.pack(at, pages, len(buckets), n, index.depth))


def read_index(store, path: str) -> Iterator[list[tuple[list[tuple], bytes | None]]]:
    """For each bucket, its chains split into classes of equal bytes."""
    unpack = zstandard.ZstdDecompressor()
    with store.open_input_file(path) as f:
        f.seek(f.size() - HEAD.size)
        directory, pages, buckets, _, _ = HEAD.unpack(f.read(HEAD.size))
        f.seek(pages)
        raw = f.read(directory - pages)
        at = 0
        for _ in range(buckets):
            _, count = struct.unpack_from("<BI", raw, at)
            at += 5
            chains: dict[int, list[tuple]] = defaultdict(list)
            for i in range(count):
                e = ENTRY.unpack_from(raw, at + i * ENTRY.size)
                chains[e[0]].append(e)
            at += count * ENTRY.size
            out = []
            for chain in chains.values():
                if len(chain) == 1:
                    out.append(chain)
                    continue
                classes: list[tuple[bytes, list[tuple]]] = []
                for e in chain:
                    f.seek(e[5])
                    text = unpack.decompress(f.read(e[6]))
                    for held, members in classes:
                        if held == text:
                            members.append(e)
                            break
                    else:
                        classes.append((text, [e]))
                out += [members for _, members in classes]
            yield out


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


STAGED = "row long, id long, rep long, key long, sha string, best_id long, best_row long, n long, text binary"


def _chunks(hash_bits: int, chunk_rows: int):
    mask = (1 << hash_bits) - 1

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        base = TaskContext.get().partitionId() << 33
        row = base
        for b in batches:
            for lo in range(0, b.num_rows, chunk_rows):
                part = b.slice(lo, chunk_rows)
                ids = part.column(0).to_pylist()
                texts = [t.encode().lower() for t in part.column(1).to_pylist()]  # bytes.lower() changes A-Z only
                seen: dict[int, list[int]] = defaultdict(list)  # key -> representatives, by position
                rep, key, best, n = [], [], {}, defaultdict(int)
                for i, t in enumerate(texts):
                    k = xxhash.xxh3_64_intdigest(t) & mask
                    r = next((j for j in seen[k] if texts[j] == t), None)
                    if r is None:
                        seen[k].append(r := i)
                    rep.append(r)
                    key.append(_signed(k))
                    n[r] += 1
                    best[r] = max(best.get(r, (ids[i], i)), (ids[i], i))
                sha: dict[int, str] = {r: hashlib.sha256(texts[r]).hexdigest() for r in best}
                lead = [i if rep[i] == i else None for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array([row + r for r in rep], pa.int64()), pa.array(key, pa.int64()),
                    pa.array([sha[r] for r in rep], pa.string()), pa.array([None if i is None else best[i][0] for i in lead], pa.int64()), pa.array([None if i is None else row + best[i][1] for i in lead], pa.int64()),
                    pa.array([None if i is None else n[i] for i in lead], pa.int64()), pa.array([None if i is None else pack(texts[i]) for i in lead], pa.binary()),
                ], names=["row", "id", "rep", "key", "sha", "best_id", "best_row", "n", "text"])
                row += len(ids)

    return run


def _owner(folder: str, capacity: int):
    def run(batches):
        store, at = open_store(folder)
        path = f"{at}/owner-{TaskContext.get().partitionId():06d}.ehx"

        def entries():
            for b in batches:
                for key, rep, best_id, best_row, n, text in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    yield (key & 0xFFFFFFFFFFFFFFFF, rep, best_id, best_row, n), text

        write_index(store, path, entries(), capacity)
        for classes in read_index(store, path):
            rep, keep_id, keep_row, size = [], [], [], []
            for members in classes:
                best, total = max((e[2], e[3]) for e in members), sum(e[4] for e in members)
                rep += [e[1] for e in members]
                keep_id += [best[0]] * len(members)
                keep_row += [best[1]] * len(members)
                size += [total] * len(members)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rep, keep_id, keep_row, size)], names=["rep", "keep_id", "keep_row", "group_size"])

    return run


def extendible_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hash_bits: int = 64, bucket_capacity: int = 256, chunk_rows: int = 2000) -> DataFrame:
    """Group rows whose texts agree after lower-casing A-Z only.

    Returns one row per input row: id, keep_id (largest id of the group),
    group_size (rows), kept (exactly one row of each group), text_sha256 (of the
    normalised text).  Null text is empty text; empty texts are equal to each
    other.  Of rows with equal text and equal id one, the last read, is kept.
    Rows with a null id are left out.  An empty table gives an empty result.
    hash_bits under 64 only makes collisions likelier (used by tests).
    """
    spark = docs.sparkSession
    small_batches(spark)
    staged = stored(id_text(docs, id_col, text_col).mapInArrow(_chunks(hash_bits, chunk_rows), STAGED), "ehx-chunks")
    folder = shared_dir(spark, "ehx-index")
    store, at = open_store(folder)
    store.create_dir(at)
    reps = staged.where(F.col("rep") == F.col("row")).select("key", "rep", "best_id", "best_row", "n", "text")
    verdicts = live_with(reps.repartitionByRange(tasks(spark), "key").mapInArrow(_owner(folder, bucket_capacity), "rep long, keep_id long, keep_row long, group_size long"), folder)
    rows = staged.select("row", "id", "rep", "sha")
    return rows.join(verdicts.hint("merge"), "rep").select(F.col("id"), F.col("keep_id"), F.col("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
