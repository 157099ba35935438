"""Quality classifier from positive and unlabelled texts.

Trusted positives are documents whose labels all say so; the unlabelled ones are web text of unknown mixture, of
which the classifier sees no label.  Labels of low quality teach nothing.  A linear model z(x) minimises the
non-negative unbiased risk

    prior * E_pos[loss(z)] + max(0, E_unl[loss(-z)] - prior * E_pos[loss(-z)])

with the logistic loss: the second term is the risk on negatives, freed of the positives that the unlabelled texts
hold; where a batch makes it negative, the step goes the other way, which stops the model from fitting noise.

The class prior is estimated first.  A model that tells positives from unlabelled texts is fitted on one half of
the sample; on the other half the prior is the least ratio, over thresholds, of the unlabelled share above it to the
positive share above it, each threshold with its sampling error on top.

Fitting takes a bounded sample (``per_class`` rows of each kind, by a hash of the id).  The sample is dealt to a
fixed number of shards; each shard's task goes over its rows in batches from the common weights, and the weights of
all shards are averaged after a round.  So the fit is the same on any number of executors, and each task holds a bounded
part of a bounded sample.  Scoring is one pass over all documents.

Features are of the text alone: shares of the byte classes and their pairs (letters, digits, white space, each
sign on its own), and statistics of words and lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, rows_of, stored

#: Bytes of a text that are looked at together; statistics of repeats are those within such pieces.
PIECE = 1 << 20
SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
#: Classes of bytes: a-z, A-Z, 0-9, space, line end, other control bytes, bytes of other characters, each sign.
CLASSES = 7 + len(SIGNS)


def _class_table() -> np.ndarray:
    out = np.full(256, 5, np.int32)
    for k, group in enumerate((range(97, 123), range(65, 91), range(48, 58), [32], [10])):
        out[list(group)] = k
    out[128:] = 6
    out[SIGNS] = range(7, CLASSES)
    return out


TABLE = _class_table()
STATISTICS = ["length", "same word again", "words again", "pairs again", "lines again", "word size", "words in capitals", "words without letters", "short lines", "bias"]
DIMS = CLASSES + CLASSES * CLASSES + len(STATISTICS)


def _pieces(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, values) of a text's features that are not 0."""
    raw = text.encode()
    one, two = np.zeros(CLASSES, np.int64), np.zeros(CLASSES * CLASSES, np.int64)
    words = again = pairs = pairs_again = same = capitals = bare = lines = lines_again = short = size = 0
    last, last_class = None, None
    for piece in _pieces(raw):
        c = TABLE[np.frombuffer(piece, np.uint8)]
        one += np.bincount(c, minlength=CLASSES)
        c = c if last_class is None else np.concatenate(([last_class], c))
        two += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        last_class = c[-1]
        own = piece.split()
        words += len(own)
        size += sum(map(len, own))
        again += len(own) - len(set(own))
        pairs += max(0, len(own) - 1)
        pairs_again += max(0, len(own) - 1) - len(set(zip(own, own[1:], strict=False)))
        same += sum(map(bytes.__eq__, own, [last or b"", *own]))
        capitals += sum(map(bytes.isupper, own))
        bare += sum(not w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in own)
        rows = [x for x in piece.split(b"\n") if x.strip()]
        lines += len(rows)
        lines_again += len(rows) - len(set(rows))
        short += sum(len(x) < 30 for x in rows)
        last = own[-1] if own else last
    share = lambda a, b: a / max(b, 1)
    stats = [min(math.log1p(words) / 10, 1), share(same, words), share(again, words), share(pairs_again, pairs), share(lines_again, lines), min(share(size, words) / 10, 1), share(capitals, words), share(bare, words), share(short, lines), 1.0]
    values = np.concatenate([np.sqrt(one / max(len(raw), 1)), np.sqrt(two / max(len(raw) - 1, 1)), stats])
    at = np.flatnonzero(values)
    return at, values[at]


BLOCK = "shard int, positive binary, pointers binary, dims binary, values binary"
#: Bins of a score in 0..1 by which thresholds for the prior are told.
SCORE_BINS = 1 << 16


def _sample(docs: DataFrame, positives: DataFrame, share: float, shards: int) -> DataFrame:
    """(id, positive, shard, dims, values): the features of sampled rows of docs (id, text); a row may come as a
    positive, as an unlabelled one, or as both.  positives: (id, positive) of a bounded number of ids."""
    hashed = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20))
    d = docs.join(F.broadcast(positives), "id", "left").withColumns({"unlabelled": hashed(1) < share * (1 << 20), "shard": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards)).cast("int")})
    d = d.where("unlabelled OR positive").select("id", "text", "shard", F.coalesce("positive", F.lit(False)).alias("positive"), "unlabelled")

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(5)]
            for (i, text), shard, positive, unlabelled in zip(rows_of([b]), *(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                at, values = text_features(text)
                for kind in [True] * positive + [False] * unlabelled:
                    for c, v in zip(cols, (i, kind, shard, at.astype("<u2").tobytes(), values.astype("<f4").tobytes()), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "positive", "shard", "dims", "values"])

    return d.mapInArrow(run, "id long, positive boolean, shard int, dims binary, values binary")


def _blocks(sample: DataFrame) -> DataFrame:
    """One row per shard: its part of the bounded sample, in an order that no partitioning changes."""

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "positive", "dims", "values")), strict=True))
        pointers = np.concatenate(([0], np.cumsum([len(r[2]) // 2 for r in rows])))
        cells = [np.array([r[1] for r in rows], np.uint8).tobytes(), pointers.astype("<i8").tobytes(), b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)]
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip(("positive", "pointers", "dims", "values"), cells, strict=True)}})

    return sample.groupBy("shard").applyInArrow(one, BLOCK)


def _dense(positive: bytes, pointers: bytes, dims: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positives, unlabelled): the rows of a block in full."""
    at = np.frombuffer(pointers, "<i8")
    out = np.zeros((len(at) - 1, DIMS), np.float32)
    out[np.repeat(np.arange(len(out)), np.diff(at)), np.frombuffer(dims, "<u2")] = np.frombuffer(values, "<f4")
    kind = np.frombuffer(positive, np.uint8) > 0
    return out[kind], out[~kind]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_gradient(w: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float | None) -> np.ndarray:
    """Direction of descent of the non-negative unbiased risk on a batch; without a prior, the gradient of the logistic
    loss of telling positives from unlabelled rows."""
    zp, zu = pos @ w, unl @ w
    up, down, off = _logistic(-zp) @ pos / len(pos), _logistic(zp) @ pos / len(pos), _logistic(zu) @ unl / len(unl)
    if prior is None:
        return (off - up) / 2
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return -prior * up + (off - prior * down) if negative >= 0 else -(off - prior * down)


def descend(w: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float | None, rate: float, steps: int, batch: int, decay: float, seed: int) -> np.ndarray:
    """Weights after steps over batches of both kinds, each kind in a shuffled order that starts again when it ends."""
    rng = np.random.default_rng(seed)
    order = [np.concatenate([rng.permutation(len(x)) for _ in range(1 + steps * min(batch, len(x)) // len(x))]) for x in (pos, unl)]
    m, v, w = np.zeros_like(w), np.zeros_like(w), w.copy()
    for t in range(steps):
        p, u = (x[np.sort(o[t * k : (t + 1) * k])] for x, o, k in ((pos, order[0], min(batch, len(pos))), (unl, order[1], min(batch, len(unl)))))
        g = risk_gradient(w, p, u, prior) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
    return w


def fit(blocks: DataFrame, prior: float | None, *, rounds: int, steps: int, batch: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Weights averaged over the shards after each round; a shard without rows of both kinds is left out."""
    w = np.zeros(DIMS)
    for r in range(rounds):

        def run(batches, w=w, r=r):
            for b in batches:
                for shard, *cells in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    pos, unl = _dense(*cells)
                    if len(pos) and len(unl):
                        own = descend(w, pos, unl, prior, rate / math.sqrt(1 + r), steps, batch, decay, seed + 1000 * r + shard)
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["shard", "weights"])

        rows = blocks.mapInArrow(run, "shard int, weights binary").collect()  # a row per shard
        if not rows:
            break
        w = np.mean([np.frombuffer(x["weights"]) for x in sorted(rows, key=lambda x: x["shard"])], axis=0)
    return w


def estimated_prior(blocks: DataFrame, w: np.ndarray, error: float = 0.1) -> float:
    """Share of positives among the unlabelled rows: the ratio of the two kinds' shares above a threshold, where that ratio
    plus its sampling error is least."""

    def run(batches):
        counts = np.zeros((2, SCORE_BINS), np.int64)
        for b in batches:
            for cells in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                for k, x in enumerate(_dense(*cells)):
                    counts[k] += np.bincount((_logistic(x @ w) * (SCORE_BINS - 1)).astype(int), minlength=SCORE_BINS)
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c[used], pa.int64()) for c in counts)], names=["bin", "pos", "unl"])

    rows = blocks.mapInArrow(run, "bin int, pos long, unl long").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl")).orderBy(F.desc("bin")).collect()  # at most SCORE_BINS
    pos, unl = (np.cumsum([r[c] for r in rows]) for c in ("pos", "unl"))
    if not len(rows) or not pos[-1] or not unl[-1]:
        return 0.5
    above = pos > 0
    ratio = (unl[above] / unl[-1]) / (pos[above] / pos[-1])
    slack = sum(math.sqrt(math.log(4 / error) / (2 * n)) for n in (pos[-1], unl[-1])) / (pos[above] / pos[-1])
    return float(np.clip(ratio[np.argmin(ratio + slack)], 0.01, 0.99))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, per_class: int = 20_000, shards: int = 8, rounds: int = 10, steps: int = 40, batch: int = 256, rate: float = 0.4, decay: float = 1e-5, seed: int = 7) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1, higher for better texts), predicted (1 from a score of 0.5 on)
    and prior (the estimated share of good texts among the unlabelled ones).

    Only labels and texts of rows whose crc32(id as text) mod 3 is not 1 are learnt from.  A document is a trusted
    positive if it has labels and all are 1; other labels, null ones too, make it one of the unlabelled.  per_class
    bounds the sample that the model is fitted on, in expectation: each kind's rows are kept by a hash of their ids.
    Without trusted positives in the sample nothing is learnt and every score is 0.5.  Null text is empty text; rows
    with a null id are left out; repeated rows are rows of their own.  An empty table gives an empty result."""
    texts = id_text(docs, id_col, text_col)
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1
    good = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col).eqNullSafe(F.lit(1))).alias("good")).where(F.col("id").isNotNull() & ~held)
    good = good.groupBy("id").agg(F.min("good").alias("positive")).where("positive")
    share = lambda n: min(1.0, per_class / max(n, 1))
    positives = good.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < share(good.count()) * (1 << 20))
    learnt = texts.where(~held)
    sample = _sample(learnt, positives, share(learnt.select("id").count()), shards)
    blocks = stored(_blocks(sample), "pu-blocks")
    options = {"rounds": rounds, "steps": steps, "batch": batch, "rate": rate, "decay": decay, "seed": seed}
    apart = fit(blocks.where(F.col("shard") < shards // 2), None, **options)
    prior = estimated_prior(blocks.where(F.col("shard") >= shards // 2), apart)
    w = fit(blocks, prior, **options)

    def run(batches):
        for b in batches:
            ids, scores = [], []
            for i, text in rows_of([b]):
                at, values = text_features(text)
                ids.append(i)
                scores.append(float(_logistic(np.dot(w[at], values))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["id", "score"])

    out = texts.mapInArrow(run, "id long, score double")
    return out.select("id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(prior).alias("prior"))
