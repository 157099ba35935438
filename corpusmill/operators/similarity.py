"""Exact similarity of sets, all against all: sketches tell which pairs can be similar, whole sets settle those.

A set's sketch has a bit for each bucket that an odd number of its grams hash to.  Two sketches differ in no more
bits than their sets in grams, and sets of Jaccard similarity t differ in (1 - t) / (1 + t) of their sizes' sum at
most, so no similar pair is lost.  Distances of sketches are products of matrices of 1 and -1, block by block.
Rows are blocked by size, and meet only the blocks that their size allows.  Comparisons grow with the square of the rows, at
a few nanoseconds each; what is shuffled for them is some 50 bytes a row and block.  A task holds one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and rows by bits of their sketches, at most.
BLOCK_ROWS, BLOCK_BITS = 16_384, 1 << 23
#: Rows that meet a block at a time, and of how many of its rows.
TILE, TILE_ROWS = 256, 4096
#: Bits of the shortest and the longest sketch.
LEAST_BITS, MOST_BITS = 128, 1 << 14


def _slack(threshold: float) -> float:
    return (1 - threshold) / (1 + threshold)


def sketch_bits(size: int, threshold: float) -> int:
    """Six bits for each gram by which similar sets may differ, as a power of two."""
    want, bits = 12 * _slack(threshold) * size, LEAST_BITS
    while bits < want and bits < MOST_BITS:
        bits *= 2
    return bits


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in one array, and where each list begins, with the end."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _sketch(grams: np.ndarray, bits: int) -> bytes:
    at = (grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(36)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _sketches(sets: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = _lists(b.column(1))
            made = [_sketch(flat[i:j], sketch_bits(int(j - i), threshold)) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int32)), b.column(2), pa.array(made, pa.binary())], names=["id", "size", "label", "sketch"])

    return sets.select("id", "g", "label").mapInArrow(run, "id long, size int, label string, sketch binary")


def _blocks(counts: dict[int, int], threshold: float, parts: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Least and largest size of each block, in order; for each size its first block and over how many it is dealt."""
    weight = {s: n * sketch_bits(s, threshold) for s, n in counts.items()}
    room = min(BLOCK_BITS, max(1 << 18, sum(weight.values()) // (2 * parts)))
    blocks, of, rows, bits, kind = [], {}, 0, 0, 0
    for s in sorted(counts):
        k = max(-(-weight[s] // room), -(-counts[s] // BLOCK_ROWS))
        own = sketch_bits(s, threshold)
        if blocks and k == 1 and own == kind and bits + weight[s] <= room and rows + counts[s] <= BLOCK_ROWS:
            blocks[-1] = (blocks[-1][0], s)
            rows, bits = rows + counts[s], bits + weight[s]
        else:
            blocks += [(s, s)] * k
            rows, bits, kind = counts[s] if k == 1 else BLOCK_ROWS, weight[s], own
        of[s] = (len(blocks) - k, k)
    return blocks, of


def _signs(sketches: list[bytes], bits: int, sizes: np.ndarray, factor: float, first: bool) -> np.ndarray:
    """A row of 1 and -1 for each sketch, folded to bits, and two columns that add what both sizes allow."""
    out = np.empty((len(sketches), bits + 2), np.float32)
    for k, s in enumerate(sketches):
        x = np.unpackbits(np.frombuffer(s, np.uint8))
        out[k, :bits] = np.bitwise_xor.reduce(x.reshape(-1, bits), axis=0) if len(x) > bits else x
    out[:, :bits] = 1 - 2 * out[:, :bits]
    out[:, bits], out[:, bits + 1] = (2 * factor * sizes, 1) if first else (1, 2 * factor * sizes)
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(cell, whether its held rows, rows) of batches whose first columns are cell and kind; rows are in their order."""
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(key[i]) // 2, not key[i] % 2, b.slice(i, j - i)


def _candidates(threshold: float):
    """Rows (cell, kind, id, size, label, sketch, own), in order, to (cell, kind, id, others): rows of kind 1 with the rows of
    kind 0 of their cell that they may be similar to, and those rows of kind 0, once each.  own: only smaller ids count."""
    factor, schema = _slack(threshold), pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("others", pa.list_(pa.int64()))])

    def rows(cell: int, kind: int, ids: np.ndarray, others: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), cell, np.int32)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), others], schema=schema)

    def used(cell: int, ids: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
        return rows(cell, 0, ids[hit], pa.nulls(int(hit.sum()), schema.field("others").type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, matrix = None, [], {}
        ids = sizes = hit = np.zeros(0)
        for cell, is_held, b in _grouped(batches):
            if cell != at:
                if at is not None and len(hit):
                    yield used(at, ids, hit)
                at, held, matrix, hit = cell, [], {}, np.zeros(0, bool)
            if is_held:
                held.append(b)
                continue
            if not matrix:
                ids, sizes = (np.concatenate([x.column(k).to_numpy() for x in held]) if held else np.zeros(0, np.int64) for k in (2, 3))
                labels = np.array([v for x in held for v in x.column(4).to_pylist()], object)
                sketches = [v for x in held for v in x.column(5).to_pylist()]
                hit = np.zeros(len(ids), bool)
            for k in range(0, b.num_rows if len(ids) else 0, TILE):
                part = b.slice(k, TILE)
                mine, size, label, sketch, own = part.column(2).to_numpy(), part.column(3).to_numpy(), np.array(part.column(4).to_pylist(), object), part.column(5).to_pylist(), part.column(6).to_numpy(zero_copy_only=False)
                found = []
                kinds = np.minimum(np.array([len(s) * 8 for s in sketch]), len(sketches[0]) * 8)
                for bits in np.unique(kinds).tolist():
                    if bits not in matrix:
                        matrix[bits] = _signs(sketches, bits, sizes, factor, True)
                    of = np.flatnonzero(kinds == bits)
                    left = _signs([sketch[i] for i in of], bits, size[of], factor, False)
                    for r in range(0, len(ids), TILE_ROWS):
                        near = np.flatnonzero(left @ matrix[bits][r : r + TILE_ROWS].T >= bits - 0.5)
                        n = min(TILE_ROWS, len(ids) - r)
                        x, y = of[near // n], near % n + r
                        fit = np.minimum(size[x], sizes[y]) >= threshold * np.maximum(size[x], sizes[y]) - 1e-9
                        fit &= ~own[x] | (ids[y] < mine[x])
                        x, y = x[fit], y[fit]
                        fit = label[x] == labels[y]
                        found.append((x[fit], y[fit]))
                x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                if len(x):
                    order = np.argsort(x, kind="stable")
                    x, y = x[order], y[order]
                    hit[y] = True
                    first = np.flatnonzero(np.diff(x, prepend=-1))
                    yield rows(cell, 1, mine[x[first]], pa.ListArray.from_arrays(pa.array(np.append(first, len(x)).astype(np.int32)), pa.array(ids[y])))
        if at is not None and len(hit):
            yield used(at, ids, hit)

    return run


def _settled(threshold: float, ordered: bool):
    """Rows (cell, kind, id, others, g), in order, to (a, b, similarity) of similar rows; ordered: a is the smaller id,
    else the row of kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, flat = None, [], None
        for cell, is_held, b in _grouped(batches):
            if cell != at:
                at, held, flat = cell, [], None
            if is_held:
                held.append(b)
                continue
            if flat is None:
                ids = np.concatenate([x.column(2).to_numpy() for x in held])
                order = np.argsort(ids)
                back = ids[order]
                values, sizes = zip(*[(v, np.diff(o)) for v, o in (_lists(x.column(4)) for x in held)], strict=True)
                known, flat = np.unique(np.concatenate(values), return_inverse=True)
                sizes = np.concatenate(sizes)
                begin = np.cumsum(sizes) - sizes
                mark = np.zeros(len(known) + 1, np.uint8)
                held = []
            mine, (others, of), (grams, cut) = b.column(2).to_numpy(), _lists(b.column(3)), _lists(b.column(4))
            place = np.searchsorted(known, grams)
            place[known[np.minimum(place, len(known) - 1)] != grams] = len(known)
            for k in range(len(mine)):
                own = place[cut[k] : cut[k + 1]]
                mark[own] = 1
                mark[-1] = 0
                c = order[np.searchsorted(back, others[of[k] : of[k + 1]])]
                if len(c) * 5 > len(sizes):
                    common = np.add.reduceat(mark[flat], begin, dtype=np.int64)[c]
                else:
                    n = sizes[c]
                    start = np.cumsum(n) - n
                    common = np.add.reduceat(mark[flat[np.arange(n.sum()) + np.repeat(begin[c] - start, n)]], start, dtype=np.int64)
                mark[own] = 0
                share = common / (sizes[c] + len(own) - common)
                good = share >= threshold
                if good.any():
                    x = ids[c[good]]
                    y = np.full(len(x), mine[k])
                    a, b_ = (np.minimum(x, y), np.maximum(x, y)) if ordered else (y, x)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_), pa.array(share[good])], names=["a", "b", "similarity"])

    return run


def set_pairs(sets: DataFrame, threshold: float, other: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) of rows (id long, g array<long>, label string) whose sets have at least the Jaccard similarity
    and whose labels are equal.  Sets are not empty and hold no value twice; ids are unique, and both tables give the
    same rows whenever they are read.  With other, a is of sets and b of other; else a < b."""
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = lambda x: {r[0]: r[1] for r in x.groupBy(F.size("g")).count().collect()}  # noqa: E731  # a row for each size
    mine = sizes(sets)
    blocks, of = _blocks(mine if other is None else sizes(other), threshold, parts)
    lows, highs = np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
    reach = lambda s: (int(np.searchsorted(highs, s * threshold - 1e-9)), int(np.searchsorted(lows, s / threshold + 1e-9, side="right")) - 1)
    held = spark.createDataFrame([(s, *v) for s, v in of.items()], "size int, first int, k int")
    met = spark.createDataFrame([(s, *reach(s)) for s in mine], "size int, lo int, hi int")

    block = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("k"))).cast("int")
    sketched = lambda x: _sketches(x, threshold)
    columns = ["cell", "kind", "id", "size", "label", "sketch", "own"]
    a = sketched(sets if other is None else other).join(F.broadcast(held), "size").withColumns({"cell": block, "kind": F.lit(0), "own": F.lit(False)})
    if other is None:
        b = sketched(sets).join(F.broadcast(held), "size").join(F.broadcast(met), "size").withColumn("block", block).withColumn("cell", F.explode(F.sequence("lo", "block")))
        b = b.withColumns({"kind": F.lit(1), "own": F.col("cell") == F.col("block")})
    else:
        b = sketched(sets).join(F.broadcast(met), "size").where("lo <= hi").withColumn("cell", F.explode(F.sequence("lo", "hi"))).withColumns({"kind": F.lit(1), "own": F.lit(False)})
    near = a.select(*columns).union(b.select(*columns)).repartition(parts, "cell").sortWithinPartitions("cell", "kind")
    near = near.mapInArrow(_candidates(threshold), "cell int, kind int, id long, others array<long>")
    if other is None:
        whole = near.join(sets.select("id", "g"), "id")
    else:
        whole = near.where("kind = 1").join(sets.select("id", "g"), "id").unionByName(near.where("kind = 0").join(other.select("id", "g"), "id"))
    dealt = whole.select("cell", "kind", "id", "others", "g").repartition(parts, "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(_settled(threshold, other is None), "a long, b long, similarity double")
