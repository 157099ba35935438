"""A trigram language model in a sharded Elias-Fano trie, trained and applied to a table.

Model.  With discounts D1, D2, D3 and tokens that are words or a text's end:

    P1(w)     = (c(w) - D1) / N, and for all unknown words together D1 V / N
    P2(w|v)   = max(c(vw) - D2, 0) / c(v) + D2 T(v) / c(v) P1(w)
    P3(w|u,v) = max(c(uvw) - D3, 0) / c(uv) + b(u,v) P2(w|v)      where uvw was seen twice or more

T(v): different successors of v; b(u,v): what the kept trigrams of uv leave of 1.  The discounted
shares are quantised to a byte each in the trie; T comes from its pointers.

Flow.  A block of texts keeps its tokens in a file in the shared folder and talks to the shards
that own contexts by packed messages, each different n-gram of the block once:
words (counts), then word pairs, then triples whose pairs were both seen twice, without
which a triple cannot have been.  A shard adds up the blocks' training counts, writes its level
(pointers, children relative to their parent, codes) as a file, maps it into memory and
answers by successor search.  A triple's last word is named by its place among the children of
the pair's second word, so its level's numbers are small.  Contexts that make up a large
share of all tokens are split by their successors' hashes.
"""

from __future__ import annotations

import mmap
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import atomic_output, id_text, live_with, open_store, rows_of, shared_dir, small_batches, stored, tasks
from .efcodec import Level, U, pack, unpack
from .shingles import mix, word_hashes, words_of

END, BOS = U(0x656E64206F662074), U(0x626567696E206F66)
STEP, ABSENT = 0.03, 255  # of codes, in log10
_MESSAGE = "block long, shard int, data binary"
_NAMES = ["block", "shard", "data"]


def held_out(doc: int) -> bool:
    return zlib.crc32(str(doc).encode()) % 7 == 2


def quantise(x: np.ndarray) -> np.ndarray:
    """Shares in 0..1 as bytes, rounded down so that sums stay under 1; 0 has the code ABSENT."""
    with np.errstate(divide="ignore"):
        q = np.ceil(-np.log10(x) / STEP)
    return np.where(x > 0, np.minimum(q, ABSENT - 1), ABSENT).astype(np.uint8)


SHARES = np.append(10.0 ** (-STEP * np.arange(ABSENT)), 0.0)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each key among them)."""
    order = np.argsort(key)
    s = key[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[new], place


def _messages(block: int, shards: int, parts: dict[int, bytes]) -> pa.RecordBatch:
    rows = sorted(parts.items()) or [(block % shards, pack())]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=_NAMES)


def _replies(asked: pa.Table, data: list[bytes]) -> pa.Table:
    return pa.table([asked.column(0), asked.column(1), pa.array(data, pa.binary())], names=_NAMES)


def _save(store, path: str, data: bytes) -> None:
    with atomic_output(store, path) as out:
        out.write(data)


def _load(store, path: str) -> bytes:
    with store.open_input_file(path) as f:
        return f.read()


def map_level(store, path: str) -> Level:
    """A level's file mapped into memory where the store is a local one."""
    if store.type_name == "local":
        with open(path, "rb") as f:
            raw = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
    else:
        raw = np.frombuffer(_load(store, path), np.uint8)
    return Level.load(raw)


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U(40)) * U(shards) >> U(24)).astype(np.int64)


def _by_shard(shard: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    """Ranges of equal shard in an ascending array."""
    cut = np.searchsorted(shard, np.arange(shards + 1))
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]


class Tokens:
    """A block's texts as numbers into its sorted word hashes."""

    def __init__(self, ids, lengths, words, flat):
        self.ids, self.lengths, self.words, self.flat = ids, lengths.astype(np.int64), words, flat.astype(np.int64)
        out = np.array([held_out(i) for i in ids.tolist()], bool)
        self.held = out
        self.train = np.repeat(~out, self.lengths)
        self.start = np.zeros(len(self.flat), bool)
        self.start[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = True

    def dump(self) -> bytes:
        # frequent words get small numbers, which pack better
        order = np.argsort(-np.bincount(self.flat, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return pack(self.ids.view(np.uint64), self.lengths, np.diff(self.words[order], prepend=U(0)), rank[self.flat], level=9)

    @classmethod
    def load(cls, data: bytes) -> Tokens:
        ids, lengths, words, flat = unpack(data)
        words = np.cumsum(words, dtype=np.uint64)
        order = np.argsort(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(ids.view(np.int64), lengths, words[order], place[flat.astype(np.int64)])

    def count(self, place: np.ndarray, n: int, where: np.ndarray | None = None) -> np.ndarray:
        """Training occurrences of each of n things, by the place of each token's."""
        t = self.train if where is None else self.train[where]
        return np.bincount(place[t], minlength=n)


# ------------------------------------------------------------------- words


def _ask_words(folder: str, shards: int, block_chars: int):
    def run(batches: Iterable[pa.RecordBatch]):
        store, root = open_store(folder)
        number = TaskContext.get().partitionId() << 24
        ids, parts, held = [], [], 0

        def flush():
            words, flat = grouped(np.concatenate(parts))
            t = Tokens(np.array(ids, np.int64), np.array([len(p) for p in parts]), words, flat)
            _save(store, f"{root}/{number}.tok", t.dump())
            c = t.count(t.flat, len(words))
            return _messages(number, shards, {k: pack(np.diff(words[s], prepend=U(0)), c[s]) for k, s in _by_shard(_shard_of(words, shards), shards)})

        for doc, text in rows_of(batches):
            ids.append(doc)
            parts.append(np.append(word_hashes(words_of(text)), END))
            held += len(text) + 1
            if held >= block_chars:
                yield flush()
                ids, parts, held, number = [], [], 0, number + 1
        if ids:
            yield flush()

    return run


COUNTED = "block long, shard int, data binary, n long, v long, n1 long, n2 long"


def _count_words(asked: pa.Table) -> pa.Table:
    got = [unpack(d) for d in asked.column(2).to_pylist()]
    words = [np.cumsum(g[0], dtype=np.uint64) if g else np.zeros(0, np.uint64) for g in got]
    every, place = grouped(np.concatenate(words))
    total = np.bincount(place, np.concatenate([g[1] if g else np.zeros(0) for g in got]).astype(float), len(every)).astype(np.int64)
    out, at = [], 0
    for w in words:
        out.append(pack(total[place[at : at + len(w)]]))
        at += len(w)
    stats = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
    first = lambda x: pa.array([x] + [0] * (len(out) - 1), pa.int64())
    return pa.table([asked.column(0), asked.column(1), pa.array(out, pa.binary()), *map(first, stats)], names=[*_NAMES, "n", "v", "n1", "n2"])


def _joined(answers: pa.Table) -> list[bytes]:
    """A block's answers in the order of shards."""
    return [d for _, d in sorted(zip(answers.column(1).to_pylist(), answers.column(2).to_pylist(), strict=True), key=lambda x: x[0])]


# ------------------------------------------------------------------- pairs


class Pairs:
    """The block's different word pairs in the order in which shards are asked.

    Contexts are split into 2**k parts by the successor's top bits where the context has more
    than 2**k / (4 shards) of all training tokens."""

    def __init__(self, t: Tokens, counts: np.ndarray, texts: int, total: int, shards: int):
        n = len(t.words)
        before = np.empty(len(t.flat), np.int64)
        before[1:] = t.flat[:-1]
        before[t.start] = n  # the begin of a text
        key, self.of_token = grouped((before * (n + 1) + t.flat).astype(np.uint64))
        v, w = (key // U(n + 1)).astype(np.int64), (key % U(n + 1)).astype(np.int64)
        share = np.append(counts, texts) * (4.0 * shards) / max(1, total)
        self.split = np.ceil(np.log2(np.maximum(share, 1.0))).astype(np.int64)  # bits per context
        self.hash = np.append(t.words, BOS)
        bits = self.split[v].astype(np.uint64)
        part = np.where(bits > 0, self.hash[w] >> (U(64) - np.maximum(bits, U(1))), U(0))
        # every part of a split context is asked for its number of successors
        hot = np.flatnonzero((self.split > 0) & np.isin(np.arange(n + 1), v))
        cv = np.concatenate([v, np.repeat(hot, 1 << self.split[hot])])
        cp = np.concatenate([part, np.concatenate([np.arange(1 << b, dtype=np.uint64) for b in self.split[hot].tolist()]) if len(hot) else np.zeros(0, np.uint64)])
        ctx = mix(self.hash[cv] + cp * U(0x9E3779B97F4A7C15))
        self.contexts, place = grouped(ctx)
        self.context_word = np.zeros(len(self.contexts), np.int64)
        self.context_word[place] = cv
        # successors of a context by as many bits as its count calls for; one in 2**14 meets another
        wide = np.clip(14 + np.ceil(np.log2(np.append(counts, texts) + 1.0)), 16, 32).astype(np.uint64)[v]
        succ = (self.hash[w] << bits) >> (U(64) - wide)
        order = np.argsort(place[: len(v)].astype(np.uint64) << U(32) | succ)
        self.v, self.w, self.part, self.succ, self.ctx = v[order], w[order], part[order], succ[order], place[: len(v)][order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of_token = rank[self.of_token]
        self.shards = _by_shard(_shard_of(self.contexts, shards), shards)
        self.edge = np.searchsorted(self.ctx, np.arange(len(self.contexts) + 1))  # pairs of each context
        self.shard_of_context = _shard_of(self.contexts, shards)


def _ask_pairs(folder: str, shards: int, texts: int, total: int):
    def run(answers: pa.Table) -> pa.Table:
        store, root = open_store(folder)
        number = answers.column(0)[0].as_py()
        t = Tokens.load(_load(store, f"{root}/{number}.tok"))
        counts = np.concatenate([x[0] for d in _joined(answers) if (x := unpack(d))] or [np.zeros(0, np.uint64)]).astype(np.int64)
        _save(store, f"{root}/{number}.cnt", pack(counts))
        p = Pairs(t, counts, texts, total, shards)
        c = t.count(p.of_token, len(p.v))
        # a whole context's count is the sum of its pairs'; only the parts of a split one are told it
        context_count = np.where(p.split[p.context_word] > 0, np.append(counts, texts)[p.context_word], 0)
        parts = {}
        for k, s in p.shards:
            a, b = p.edge[s.start], p.edge[s.stop]
            parts[k] = pack(np.diff(p.contexts[s], prepend=U(0)), context_count[s], np.diff(p.edge[s.start : s.stop + 1]), p.succ[a:b], c[a:b])
        return pa.Table.from_batches([_messages(number, shards, parts)])

    return run


def _answer_pairs(folder: str, discount: float):
    def run(asked: pa.Table) -> pa.Table:
        store, root = open_store(folder)
        got = [unpack(d) or [np.zeros(0, np.uint64)] * 5 for d in asked.column(2).to_pylist()]
        mine = [np.cumsum(g[0], dtype=np.uint64) for g in got]
        contexts, place = grouped(np.concatenate(mine))
        total = np.zeros(len(contexts), np.int64)
        total[place] = np.concatenate([g[1] for g in got]).astype(np.int64)
        sizes = np.concatenate([g[2] for g in got]).astype(np.int64)
        succ, c = np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got]).astype(np.int64)
        parent = np.repeat(place, sizes)
        key, pair = grouped((parent.astype(np.uint64) << U(32)) | succ)
        count = np.bincount(pair, c.astype(float), len(key)).astype(np.int64)
        seen = count > 0  # pairs that only held-out texts have are asked for, not learnt
        key, count = key[seen], count[seen]
        owner = (key >> U(32)).astype(np.int64)
        total = np.where(total > 0, total, np.bincount(owner, count, len(contexts)).astype(np.int64))
        share = np.maximum(count - discount, 0) / np.maximum(total[owner], 1)
        path = f"{root}/{asked.column(1)[0].as_py():06d}.l2"
        _save(store, path, Level.of(np.bincount(owner, minlength=len(contexts)), key & U(0xFFFFFFFF), quantise(share)).dump())
        level = map_level(store, path)
        node = level.search(parent, succ)
        lo, hi = level.range(np.arange(len(contexts)))
        code = np.where(node >= 0, level.codes[np.maximum(node, 0)] if len(level.codes) else ABSENT, ABSENT)
        many = np.where(node >= 0, count[np.maximum(node, 0)] if len(count) else 0, 0)
        many = np.where(many > 1, many, 0)
        out, at, ctx = [], 0, 0
        for m, g in zip(mine, got, strict=True):
            k, q = place[ctx : ctx + len(m)], slice(at, at + int(g[2].sum()))
            ctx, at = ctx + len(m), q.stop
            twice = many[q] > 0
            out.append(pack(np.diff(lo[k], prepend=0), hi[k] - lo[k], code[q], many[q], (node[q] - lo[parent[q]])[twice]))
        return _replies(asked, out)

    return run


# ----------------------------------------------------------------- triples


class Answered:
    """What the shards said about a block's contexts and pairs."""

    def __init__(self, data: list[bytes]):
        got = [[np.cumsum(x[0]), *x[1:]] for d in data if (x := unpack(d))]
        self.first, self.children, self.code, self.many, place = (np.concatenate([g[i] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64) for i in range(5))
        self.place = np.full(len(self.many), -1, np.int64)
        self.place[self.many > 0] = place


class Triples:
    """The block's triples whose two pairs were seen twice, and their contexts, by shard and node."""

    def __init__(self, t: Tokens, p: Pairs, a: Answered, shards: int):
        here = np.flatnonzero(~t.start)
        second, first = p.of_token[here], p.of_token[here - 1]
        here, first, second = (x[a.many[first] > 0] for x in (here, first, second))
        node = a.first[p.ctx] + a.place  # of each pair with a node
        shard = p.shard_of_context[p.ctx]
        heads, _ = grouped(first.astype(np.uint64))
        heads = heads.astype(np.int64)
        order = np.argsort(shard[heads].astype(np.uint64) << U(40) | node[heads].astype(np.uint64))
        self.heads = heads[order]  # pairs that are contexts
        number = np.full(len(p.v), -1, np.int64)
        number[self.heads] = np.arange(len(heads))
        self.token, self.head = here, number[first]
        on = a.many[second] > 0
        # the place among the successors of the pair's second word, counted over its parts
        relative = (a.place << p.split[p.v]) | p.part.astype(np.int64)
        key, place = grouped((self.head[on].astype(np.uint64) << U(40)) | relative[second[on]].astype(np.uint64))
        self.triple = np.full(len(here), -1, np.int64)
        self.triple[on] = place
        self.relative, self.of_head = key & U((1 << 40) - 1), (key >> U(40)).astype(np.int64)
        self.node, self.many = node[self.heads], a.many[self.heads]
        self.shards = _by_shard(shard[self.heads], shards)
        self.edge = np.searchsorted(self.of_head, np.arange(len(heads) + 1))


def _block(folder: str, number: int, shards: int, texts: int, total: int):
    store, root = open_store(folder)
    t = Tokens.load(_load(store, f"{root}/{number}.tok"))
    counts = (unpack(_load(store, f"{root}/{number}.cnt")) or [np.zeros(0)])[0].astype(np.int64)
    return store, root, t, counts, Pairs(t, counts, texts, total, shards)


def _ask_triples(folder: str, shards: int, texts: int, total: int):
    def run(answers: pa.Table) -> pa.Table:
        number = answers.column(0)[0].as_py()
        store, root, t, _, p = _block(folder, number, shards, texts, total)
        a = Answered(_joined(answers))
        _save(store, f"{root}/{number}.two", b"".join(struct.pack("<I", len(d)) + d for d in _joined(answers)))
        q = Triples(t, p, a, shards)
        on = q.triple >= 0
        c = t.count(q.triple[on], len(q.relative), q.token[on])
        parts = {}
        for k, s in q.shards:
            lo, hi = q.edge[s.start], q.edge[s.stop]
            parts[k] = pack(np.diff(q.node[s], prepend=0), q.many[s], np.diff(q.edge[s.start : s.stop + 1]), q.relative[lo:hi], c[lo:hi])
        return pa.Table.from_batches([_messages(number, shards, parts)])

    return run


def _answer_triples(folder: str, discount: float, least: int):
    def run(asked: pa.Table) -> pa.Table:
        store, root = open_store(folder)
        got = [unpack(d) or [np.zeros(0, np.uint64)] * 5 for d in asked.column(2).to_pylist()]
        mine = [np.cumsum(g[0]).astype(np.uint64) for g in got]
        nodes, place = grouped(np.concatenate(mine))
        total = np.zeros(len(nodes), np.int64)
        total[place] = np.concatenate([g[1] for g in got]).astype(np.int64)
        parent = np.repeat(place, np.concatenate([g[2] for g in got]).astype(np.int64))
        relative, c = np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got]).astype(np.int64)
        key, triple = grouped((parent.astype(np.uint64) << U(40)) | relative)
        count = np.bincount(triple, c.astype(float), len(key)).astype(np.int64)
        kept = count >= least
        key, count = key[kept], count[kept]
        owner = (key >> U(40)).astype(np.int64)
        codes = quantise(np.maximum(count - discount, 0) / np.maximum(total[owner], 1))
        path = f"{root}/{asked.column(1)[0].as_py():06d}.l3"
        _save(store, path, Level.of(np.bincount(owner, minlength=len(nodes)), key & U((1 << 40) - 1), codes).dump())
        level = map_level(store, path)
        node = level.search(parent, relative)
        code = np.where(node >= 0, level.codes[np.maximum(node, 0)] if len(level.codes) else ABSENT, ABSENT)
        left = np.maximum(1.0 - np.bincount(owner, SHARES[codes], len(nodes)), 0.0)  # of the shares as they are stored
        rest = np.round(left * 65535).astype(np.int64)
        out, at, n = [], 0, 0
        for m, g in zip(mine, got, strict=True):
            k, q = place[n : n + len(m)], slice(at, at + int(g[2].sum()))
            n, at = n + len(m), q.stop
            out.append(pack(rest[k], code[q]))
        return _replies(asked, out)

    return run


RESULT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(folder: str, shards: int, texts: int, total: int, distinct: int, d1: float, d2: float):
    def run(answers: pa.Table) -> pa.Table:
        number = answers.column(0)[0].as_py()
        store, root, t, counts, p = _block(folder, number, shards, texts, total)
        two, at, said = _load(store, f"{root}/{number}.two"), 0, []
        while at < len(two):
            size = struct.unpack_from("<I", two, at)[0]
            said.append(two[at + 4 : at + 4 + size])
            at += 4 + size
        a = Answered(said)
        q = Triples(t, p, a, shards)
        got = [x for d in _joined(answers) if (x := unpack(d))]
        rest = np.concatenate([g[0] for g in got]).astype(float) / 65535 if got else np.zeros(0)
        code3 = np.concatenate([g[1] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        n = max(total, 1)
        p1 = np.where(counts > 0, (counts - d1) / n, max(d1 * distinct, 1.0) / n)
        context_total = np.append(counts, texts).astype(float)
        types = np.bincount(p.context_word, a.children.astype(float), len(t.words) + 1)
        back = np.where(context_total > 0, d2 * types / np.maximum(context_total, 1), 1.0)
        back = np.where(types > 0, back, 1.0)
        pair = p.of_token
        prob = SHARES[a.code[pair]] + back[p.v[pair]] * p1[p.w[pair]] if len(pair) else np.zeros(0)
        if len(q.token):
            share = np.where(q.triple >= 0, SHARES[code3[np.maximum(q.triple, 0)]] if len(code3) else 0.0, 0.0)
            prob[q.token] = share + rest[q.head] * prob[q.token]
        edges = np.concatenate(([0], np.cumsum(t.lengths)))
        total_of = lambda x: np.add.reduceat(x, edges[:-1]) if len(x) else np.zeros(0)  # noqa: E731  every text has its end
        c = counts[t.flat]
        base = total_of(np.log10((c + 1) / (total + (distinct + 1))))
        score = total_of(np.log10(np.maximum(prob, 1e-300)))
        known = total_of((c > 0).astype(np.int64))
        k = len(t.ids)
        return pa.table([
            pa.array(t.ids, pa.int64()), pa.array(t.held, pa.bool_()), pa.array(t.lengths, pa.int64()), pa.array(known, pa.int64()),
            pa.array([total] * k, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
        ], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, d2: float = 0.75, d3: float = 0.75, least: int = 2, block_chars: int = 15_000_000) -> DataFrame:
    """Train on the rows whose crc32(id) mod 7 is not 2 and score all rows.

    Columns: id, held_out, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (add-one unigrams, log10), score (the model's log10
    probability).  Null text is empty and has its end alone.  Repeated rows count as often
    as they occur; rows with a null id are left out; an empty table gives an empty
    result; with nothing to train on, all words are unknown.  least: count from which a
    triple is kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "ngram")
    store, root = open_store(folder)
    store.create_dir(root)
    shards = 4 * tasks(spark)
    dealt = lambda df, key: df.repartition(tasks(spark), key).groupBy(key)  # noqa: E731  packed rows are small and costly, so partitions are not joined by size
    asked = id_text(docs, id_col, text_col).mapInArrow(_ask_words(folder, shards, block_chars), _MESSAGE)
    words = stored(dealt(asked, "shard").applyInArrow(_count_words, COUNTED), "ngram-words")
    total, distinct, n1, n2 = (int(x or 0) for x in words.agg(F.sum("n"), F.sum("v"), F.sum("n1"), F.sum("n2")).first())
    d1 = n1 / (n1 + 2 * n2) if n1 else 0.0
    texts = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").where(F.crc32(F.col("id").cast("string").cast("binary")) % 7 != 2).count()
    args = (folder, shards, texts, total)
    pairs = dealt(words.select("block", "shard", "data"), "block").applyInArrow(_ask_pairs(*args), _MESSAGE)
    answered = dealt(pairs, "shard").applyInArrow(_answer_pairs(folder, d2), _MESSAGE)
    triples = dealt(answered, "block").applyInArrow(_ask_triples(*args), _MESSAGE)
    scored = dealt(triples, "shard").applyInArrow(_answer_triples(folder, d3, least), _MESSAGE)
    return live_with(dealt(scored, "block").applyInArrow(_score(*args, distinct, d1, d2), RESULT), folder)
