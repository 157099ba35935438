"""Near-duplicate documents by ProbMinHash, banding and verification.

Similarity.  A text's five-word shingles weigh as much as they are often.  Two texts are linked if
the probability Jaccard similarity of these weights is at least the threshold, or if that of their sets
(unit weights: the Jaccard similarity) is, so that neither a repeated passage nor a text's rest
hides a copy.

Signatures.  A shingle is a Poisson process whose rate is its weight; each
arrival takes a random register, and a register keeps the shingle that arrives first.  Two
texts' registers agree with their probability Jaccard similarity.  Arrivals come in order of time, so those after a
time by which all registers are nearly surely taken are never drawn; a text
that has registers left by then goes on with twice the time, so the bound changes no
signature.  A text whose shingles are not all equally frequent has two signatures, by counts and by
unit weights; for others they are the same.

Banding.  Texts that are equal in words are first joined to one representative.  A bucket is
a band's registers; its hubs are its least id and a few least by hash, which are
minima that combine before the shuffle.  Members are first compared with hubs, so that
a bucket with a third of all rows that are near copies costs its length.

Verification.  All pairs are checked by their exact similarities; first those with each bucket's least id, then, for
texts that these left in different classes, those with the other hubs.  Classes are the
connected components of the links.

Rest.  Buckets whose members are in different classes after that are compared whole, within workers and
in cells of bounded size: a bucket is cut into blocks, every two of which meet.  A pair of signatures is
looked at in the first bucket that it shares; where its classes differ and at least half of its registers
agree, its similarity is counted exactly through the cell's inverted index.  There, the sum of the lesser
shares of common shingles bounds the probability Jaccard similarity from above, so that is worked out for few pairs.  Registers of two texts
at 0.8 agree with chance 0.8 each, so fewer than 48 of 96 agree with a chance under 6e-10, a
small part of the chance (3e-6) of sharing no bucket at all.  Only links that
connect classes leave a cell, so the links told are fewer than the members.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_batches, stored, tasks
from .components import components
from .shingles import U, counted, jaccard, mix, probability_jaccard, shingles, word_hashes, words_of

HASH_BITS = 52  # of a shingle's hash within a group of texts
ROUNDING = 1e-9  # of sums of shares
SLACK = 0.3  # pairs with a share of registers alike that is lower by more than the threshold are not verified


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def signatures(groups: list[np.ndarray], m: int, plain: int | None = None) -> np.ndarray:
    """m 16-bit registers of each text from its shingle hashes, repeats being weights; those of the first
    ``plain`` texts count once.  At most 4096 texts.  Texts without shingles have zeros."""
    out = np.zeros((len(groups), m), np.uint16)
    sizes = np.array([len(g) for g in groups])
    if not sizes.sum():
        return out
    key = np.sort((np.concatenate(groups) >> U(64 - HASH_BITS)) | (np.repeat(np.arange(len(groups), dtype=np.uint64), sizes) << U(HASH_BITS)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    rate = np.diff(first, append=len(key)).astype(np.float64)
    key = key[first]
    doc, element = (key >> U(HASH_BITS)).astype(np.int64), key & U((1 << HASH_BITS) - 1)
    rate[doc < (plain or 0)] = 1.0
    total = np.bincount(doc, weights=rate, minlength=len(groups))
    seed = mix(element * U(0x9E3779B97F4A7C15) + U(1))
    # time by which all registers are taken but for one text in e**6
    until = np.divide(m * (np.log(m) + 6.0), total, out=np.zeros(len(groups)), where=total > 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        chosen = np.zeros(len(groups), bool)
        chosen[todo] = True
        rows = np.flatnonzero(chosen[doc])
        d, s, w, t, j = doc[rows], seed[rows], rate[rows], np.zeros(len(rows)), 0
        found = []
        while len(rows):
            j += 1
            x = mix(s + U(j * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log1p(-_uniform(x)) / w
            on = np.flatnonzero(t <= until[d])
            rows, d, s, w, t, x = rows[on], d[on], s[on], w[on], t[on], x[on]
            found.append((t, d * m + (mix(x + U(0x2545F4914F6CDD1D)) % U(m)).astype(np.int64), rows))
        t, place, who = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-t)  # the earliest arrival is written last
        winner = np.full(len(groups) * m, -1, np.int64)
        winner[place[order]] = who[order]
        full = (winner.reshape(-1, m)[todo] >= 0).all(axis=1)
        done = todo[full]
        out[done] = (mix(seed[winner.reshape(-1, m)[done]]) & U(0xFFFF)).astype(np.uint16)
        todo = todo[~full]
        until[todo] *= 2
    return out


def _uneven(x: np.ndarray) -> bool:
    """Whether shingles are not all equally frequent."""
    counts = np.unique(x, return_counts=True)[1]
    return len(counts) > 0 and counts.max() > counts.min()


def _sign(m: int, group_bytes: int = 1 << 20, most: int = 2048):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lo = 0
            while lo < len(ids):
                hi, size = lo, 0
                keys, groups = [], []
                while hi < len(ids) and hi - lo < most and (hi == lo or size + len(texts[hi]) <= group_bytes):
                    words = words_of(texts[hi])
                    size += len(texts[hi])
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                    groups.append(shingles(word_hashes(words)))
                    hi += 1
                uneven = [k for k, g in enumerate(groups) if _uneven(g)]
                sig = [s.tobytes() for s in signatures([*groups, *(groups[k] for k in uneven)], m, len(groups))]
                weighted = dict(zip(uneven, sig[len(groups) :], strict=True))
                columns = [pa.array(ids[lo:hi], pa.int64()), pa.array(keys, pa.binary()), pa.array(sig[: len(groups)], pa.binary()), pa.array([weighted.get(k) for k in range(len(groups))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "sig", "weighted"])
                lo = hi

    return run


def _pack_text(batches):
    for b in batches:
        packed = [zstandard.compress(t.encode(), 1) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["id", "packed"])


def alike(x: tuple[np.ndarray, np.ndarray | None], y: tuple[np.ndarray, np.ndarray | None], threshold: float) -> bool:
    """Whether two texts, as counted() gives them, are to be linked."""
    if jaccard(x[0], y[0]) >= threshold:
        return True
    return (x[1] is not None or y[1] is not None) and probability_jaccard(*x, *y) >= threshold - ROUNDING


def _verify(threshold: float):
    def run(batches):
        last: tuple = (None, None)
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if x != last[0]:
                    last = (x, counted(zstandard.decompress(x).decode()))
                keep.append(alike(last[1], counted(zstandard.decompress(y).decode()), threshold))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def _bands(sig: np.ndarray, rows: int, count: int) -> list[np.ndarray]:
    """The first ``count`` bands of each row of sig as one number, equal where the registers are."""
    parts = [np.ascontiguousarray(sig[:, k * rows : (k + 1) * rows]) for k in range(count)]
    if rows in (1, 2, 4):
        return [x.view(f"u{2 * rows}").ravel() for x in parts]
    return [np.unique(x, axis=0, return_inverse=True)[1].ravel() for x in parts]


def _candidates(cell: pa.Table, rows: int, least: int):
    """(a, array of b): pairs of a cell's members that are to be verified.  They have different roots, at
    least so many registers alike, and no earlier band in common, as those met in its bucket."""
    n = cell.num_rows
    root, block = cell["root"].to_numpy(), cell["block"].to_numpy()
    low, high = cell["i"][0].as_py(), cell["j"][0].as_py()
    x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
    if (root == root[0]).all() or not len(x) or not len(y):
        return
    sig = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint16).reshape(n, -1)
    bands = _bands(sig, rows, cell["band"][0].as_py())
    columns = [np.ascontiguousarray(c) for c in sig.T]
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        ok = root[part][:, None] != root[y]
        if low == high:
            ok &= part[:, None] < y
        for c in bands:
            ok &= c[part][:, None] != c[y]
        if ok.any():
            same = np.zeros(ok.shape, np.uint16)
            for c in columns:
                same += c[part][:, None] == c[y]
            ok &= same >= least
            for r in np.flatnonzero(ok.any(axis=1)):
                yield part[r], y[ok[r]]


def _cells(batches, keys=("bucket", "i", "j")):
    """Tables of the rows of one cell each, from batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys])
        ends = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        if held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        lo = 0
        for hi in ends[:-1]:
            yield pa.Table.from_batches([*held, b.slice(lo, hi - lo)])
            held, lo = [], hi
        held.append(b.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def _wanted(rows: int, least: int):
    """(rep, bucket, kind) of members that have a pair to be verified in the bucket."""

    def run(batches):
        for cell in _cells(batches):
            hit = np.zeros(cell.num_rows, bool)
            for a, b in _candidates(cell, rows, least):
                hit[a] = hit[b] = True
            if hit.any():
                yield from cell.select(["rep", "bucket", "kind"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def cell_links(sets: list[np.ndarray], pairs, threshold: float, counts: list | None = None) -> list[tuple[int, int]]:
    """Links that connect all of those pairs (a, array of b) that are alike; counts: of each set's
    elements, None where they are equal."""
    n, size = len(sets), np.array([len(s) for s in sets])
    counts = counts or [None] * n
    uneven = np.array([c is not None for c in counts])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    by_value = np.argsort(code, kind="stable")
    owner = np.repeat(np.arange(n), size)[by_value]
    count = np.bincount(code)
    first, ends = np.cumsum(count) - count, np.cumsum(size)
    # shares of the elements in their sets, in the sets' order and by value
    share = np.concatenate([np.full(len(s), 1 / max(len(s), 1)) if c is None else c / c.sum() for s, c in zip(sets, counts, strict=True)])
    share_by_value = share[by_value]
    label, out = np.arange(n), []
    for a, b in pairs:
        b = b[label[b] != label[a]]
        if not len(b):
            continue
        mine = slice(ends[a] - size[a], ends[a])
        own = code[mine]
        k = count[own]
        at = np.arange(k.sum()) + np.repeat(first[own] - (np.cumsum(k) - k), k)
        common = np.bincount(owner[at], minlength=n)[b]
        linked = common / (size[a] + size[b] - common) >= threshold
        weighed = ~linked & (uneven[b] | uneven[a])
        if weighed.any():
            bound = np.bincount(owner[at], weights=np.minimum(np.repeat(share[mine], k), share_by_value[at]), minlength=n)[b]
            for i in np.flatnonzero(weighed & (bound >= threshold - ROUNDING)):
                if label[a] != label[b[i]]:
                    linked[i] = probability_jaccard(sets[a], counts[a], sets[b[i]], counts[b[i]]) >= threshold - ROUNDING
        for x in b[linked]:
            if label[a] != label[x]:
                out.append((a, x))
                label[label == label[x]] = label[a]
    return out


def _linked(rows: int, least: int, threshold: float):
    def run(batches):
        for cell in _cells(batches):
            counts = [None if c is None else np.frombuffer(c, np.uint32) for c in cell["c"].to_pylist()]
            links = cell_links([np.frombuffer(s, np.uint64) for s in cell["s"].to_pylist()], _candidates(cell, rows, least), threshold, counts)
            if links:
                rep = cell["rep"].to_numpy()
                x, y = rep[[a for a, _ in links]], rep[[b for _, b in links]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], names=["a", "b"])

    return run


def _set_bytes(batches):
    """(rep, s, c) of packed texts: their distinct shingles as 64-bit numbers, counts as 32-bit ones (null if equal)."""
    for b in batches:
        sets = [counted(zstandard.decompress(t).decode()) for t in b.column(1).to_pylist()]
        values, counts = pa.array([s.tobytes() for s, _ in sets], pa.binary()), pa.array([None if c is None else c.astype(np.uint32).tobytes() for _, c in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), values, counts], names=["rep", "s", "c"])


def _dealt(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """Members of buckets dealt into cells (bucket, i, j) and sorted by them: a bucket is cut into blocks of
    about ``most`` in weight, and every two blocks of it meet in one cell.  So a cell's size is
    bounded, whatever its bucket's, and every two members of a bucket meet."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks"))
    d = members.join(sizes.hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    return d.repartition(tasks(members.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.8, bands: int = 24, rows: int = 4, hubs: int = 3) -> DataFrame:
    """One row per row of docs: id, class_id (least id of its class), class_size (rows), kept
    (the row's id is its class's).

    Two texts are linked if the probability Jaccard similarity of their five-word shingles, weighted
    by counts or all equally, is at least threshold.  Null text is empty; texts without words are in no class but
    their own.  Texts with equal words are in one class.  Rows with the same id are one
    document; rows with a null id are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    m = bands * rows
    base = id_text(docs, id_col, text_col)
    staged = stored(base.mapInArrow(_sign(m), "id long, key binary, sig binary, weighted binary"), "near-signatures")
    texts = staged.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("id", "sig", "weighted")).alias("r"))
    reps = stored(texts.select("key", F.col("r.id").alias("rep"), F.col("r.sig").alias("sig"), F.col("r.weighted").alias("weighted")), "near-representatives", narrow=True)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("sig")), F.struct(F.lit(1).alias("kind"), F.col("weighted").alias("sig")))
    signed = reps.select("rep", F.inline(F.filter(kinds, lambda k: k["sig"].isNotNull())))
    band = F.posexplode(F.array(*[F.substring("sig", 2 * rows * i + 1, 2 * rows) for i in range(bands)])).alias("band", "part")
    banded = signed.select("rep", "kind", band).select("rep", "kind", F.xxhash64("band", "part").alias("bucket"), F.col("band").cast("int").alias("band"))
    hub = [F.max("rep").alias("most"), F.min("rep").alias("h0")] + [F.min(F.struct(F.xxhash64("rep", "bucket", F.lit(k)), "rep"))["rep"].alias(f"h{k}") for k in range(1, hubs + 1)]
    buckets = banded.groupBy("bucket").agg(*hub).where("h0 < most").drop("most")
    member = stored(banded.join(buckets, "bucket"), "near-members", narrow=True)
    pair = lambda h: member.where(F.col("rep") != F.col(h)).select(F.least("rep", h).alias("a"), F.greatest("rep", h).alias("b"))
    nodes = member.select(F.col("rep").alias("id")).distinct()
    packed = stored(base.join(nodes, "id", "left_semi").select("id", "text").mapInArrow(_pack_text, "id long, packed binary"), "near-texts", narrow=True)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.hint("merge").join(packed.select(F.col("id").alias("b"), F.col("packed").alias("tb")), "b").join(packed.select(F.col("id").alias("a"), F.col("packed").alias("ta")), "a")
        return stored(full.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold), "a long, b long"), name, narrow=True)

    links = verified(pair("h0").distinct(), "near-links0")
    roots = components(links)
    more = pair("h1")
    for k in range(2, hubs + 1):
        more = more.union(pair(f"h{k}"))
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    apart = more.distinct().join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    links = links.union(verified(apart, "near-links1"))
    roots = components(links)
    # buckets whose members are still in different classes: all their pairs, in cells
    rooted = member.select("rep", "kind", "bucket", "band").join(roots, F.col("rep") == F.col("node"), "left").select("rep", "kind", "bucket", "band", F.coalesce("root", "rep").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("bucket")
    rest = rooted.join(mixed.hint("merge"), "bucket", "left_semi").join(signed.hint("merge"), ["rep", "kind"])
    rest = stored(rest.select("bucket", "rep", "kind", "root", "band", "sig"), "near-rest", narrow=True)
    if not rest.isEmpty():
        least = ceil(m * (threshold - SLACK))
        wanted = _dealt(rest, F.lit(1), 2048).mapInArrow(_wanted(rows, least), "rep long, bucket long, kind int").distinct()
        wanted = stored(wanted.join(rest.hint("merge"), ["rep", "bucket", "kind"]), "near-wanted", narrow=True)
        sets = packed.withColumnRenamed("id", "rep").join(wanted.select("rep").distinct().hint("merge"), "rep", "left_semi").mapInArrow(_set_bytes, "rep long, s binary, c binary")
        full = wanted.join(sets.hint("merge"), "rep")
        last = _dealt(full, F.length("s") + F.coalesce(F.length("c"), F.lit(0)) + 8192, 2048 * 8192).mapInArrow(_linked(rows, least, threshold), "a long, b long")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(stored(last, "near-links2", narrow=True)))
    classes = reps.select("key", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("root", "rep").alias("class_id"))
    out = staged.select("id", "key").join(classes, "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    sizes = out.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return out.join(sizes, "class_id").select("id", "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"))
