"""BPE encoding and decoding through a table of distinct words.

1. Map tasks split the texts into pre-token words, a block of rows at a time.  A
   block writes a file to the shared folder with the word at each position, as a
   number into the block's own word list (most frequent first, compressed), and asks
   for each of its words once: one packed message per block and shard of the word table.
2. The shard that owns a word by its hash encodes it once, however many blocks ask,
   and answers each block in the order of its question.
3. A block's answers meet again by its number; its task reads its file, looks up the ids
   of every position, and decodes them through the id-to-piece table, whose size is
   that of the vocabulary.

What moves is one word per block and distinct word, not one per occurrence, so a
word that makes up a third of all text costs no more than any other.  A task that runs
again writes the same files under the same names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import atomic_output, id_text, live_with, open_store, own_cache, rows_of, shared_dir, small_batches, tasks
from .words import UNSAFE

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The byte-level pre-tokenizer's pattern, on characters that UNSAFE does not match.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class ByteBPE:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        byte = _byte_of_char()
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()

    def split(self, text: str) -> list[str]:
        """Pre-token words and special tokens; joined they are the text."""
        if self.special and "<|" in text:
            parts = self.special.split(text)
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._split(p))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if UNSAFE.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return WORDS.findall(text)

    def encode(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for
    the characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_made: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    own_cache("pieces", _made.clear)
    if path not in _made:
        _made[path] = ByteBPE(path)
    return _made[path]


def pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    return zstandard.compress(struct.pack("<I", len(raw)) + np.array([len(r) for r in raw], "<u4").tobytes() + b"".join(raw), 1)


def unpack_words(data: bytes) -> list[str]:
    raw = zstandard.decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n).tolist()
    return [raw[a:b].decode() for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def planes(x: np.ndarray) -> bytes:
    """uint32 numbers by byte planes, which pack better than whole numbers."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


ASK = "block long, shard int, data binary"
_NAMES = ["block", "shard", "data"]


class Numbers(dict):
    """Numbers keys in order of appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _write_block(store, path: str, number: int, ids: list[int], places: list[np.ndarray], numbers: Numbers, shards: int) -> pa.RecordBatch:
    """Write a block's positions to its file; returns its questions."""
    flat = np.concatenate(places) if places else np.zeros(0, np.uint32)
    order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")  # frequent words get small numbers
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    owned: list[list[str]] = [[] for _ in range(shards)]
    asked: list[list[int]] = [[] for _ in range(shards)]
    for i, w in enumerate(numbers):
        k = zlib.crc32(w.encode()) % shards
        owned[k].append(w)
        asked[k].append(i)
    answered = rank[np.fromiter((i for a in asked for i in a), np.int64, len(rank))]
    head = struct.pack("<III", len(ids), len(rank), shards) + np.array(ids, "<i8").tobytes() + np.array([len(p) for p in places], "<u4").tobytes()
    with atomic_output(store, path) as out:
        out.write(zstandard.compress(head + np.array([len(o) for o in owned], "<u4").tobytes() + answered.astype("<u4").tobytes() + planes(rank[flat]), 3))
    rows = [(k, pack_words(o)) for k, o in enumerate(owned) if o] or [(number % shards, pack_words([]))]
    return pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=_NAMES)


def _split_blocks(tokenizer: str, folder: str, shards: int, block_chars: int):
    def run(batches: Iterable[pa.RecordBatch]):
        store, root = open_store(folder)
        bpe, number = byte_bpe(tokenizer), TaskContext.get().partitionId() << 24
        ids, places, numbers, held = [], [], Numbers(), 0
        for doc, text in rows_of(batches):
            words = bpe.split(text)
            ids.append(doc)
            places.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            held += len(text)
            if held >= block_chars:
                yield _write_block(store, f"{root}/{number}.blk", number, ids, places, numbers, shards)
                ids, places, numbers, held, number = [], [], Numbers(), 0, number + 1
        if ids:
            yield _write_block(store, f"{root}/{number}.blk", number, ids, places, numbers, shards)

    return run


def _answer(tokenizer: str):
    def run(batches: Iterable[pa.RecordBatch]):
        bpe, table = byte_bpe(tokenizer), {}
        for b in batches:
            out = []
            for data in b.column(2).to_pylist():
                words = unpack_words(data)
                new = [w for w in words if w not in table]
                table.update(zip(new, bpe.encode(new), strict=True))
                ids = [table[w] for w in words]
                out.append(zstandard.compress(np.array([len(i) // 4 for i in ids], "<u4").tobytes() + planes(np.frombuffer(b"".join(ids), "<u4")), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=_NAMES)

    return run


RESULT = "doc_id long, n_tokens long, ids binary, decoded string"


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def _join_back(tokenizer: str, folder: str):
    def run(answers: pa.Table) -> pa.Table:
        store, root = open_store(folder)
        bpe = byte_bpe(tokenizer)
        given = dict(zip(answers.column(1).to_pylist(), answers.column(2).to_pylist(), strict=True))
        docs, tokens, encoded, decoded = [], [], [], []
        for block in set(answers.column(0).to_pylist()):
            with store.open_input_file(f"{root}/{block}.blk") as f:
                raw = zstandard.decompress(f.read())
            n, words, shards = struct.unpack_from("<III", raw)
            doc_ids = np.frombuffer(raw, "<i8", n, 12)
            lengths = np.frombuffer(raw, "<u4", n, 12 + 8 * n).astype(np.int64)
            at = 12 + 12 * n
            owned = np.frombuffer(raw, "<u4", shards, at)
            order = np.frombuffer(raw, "<u4", words, at + 4 * shards)
            flat = unplanes(raw[at + 4 * shards + 4 * words :])
            counts, ids = np.zeros(words, np.int64), []
            done = 0
            for k in np.flatnonzero(owned).tolist():
                answer, m = zstandard.decompress(given[k]), int(owned[k])
                counts[done : done + m] = np.frombuffer(answer, "<u4", m)
                ids.append(unplanes(answer[4 * m :]))
                done += m
            ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            starts = np.zeros(words, np.int64)
            starts[order] = np.cumsum(counts) - counts
            size = np.zeros(words, np.int64)
            size[order] = counts
            per = size[flat]
            all_ids = ids[_ragged(starts[flat], per)].astype("<u4")
            edge = np.concatenate(([0], np.cumsum(per)))[np.concatenate(([0], np.cumsum(lengths)))].tolist()
            for doc, a, b in zip(doc_ids.tolist(), edge, edge[1:], strict=False):
                part = all_ids[a:b]
                docs.append(doc)
                tokens.append(b - a)
                encoded.append(part.tobytes())
                decoded.append(bpe.decode(part))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "ids": pa.array(encoded, pa.binary()), "decoded": pa.array(decoded, pa.string())})

    return run


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, block_chars: int = 10_000_000) -> DataFrame:
    """Ids of each whole text, and the text that they decode to.

    Columns: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.  Special
    tokens' strings in a text get their ids, none are added.  Null text is empty, and
    an empty text has no ids and decodes to the empty string.  Repeated rows give
    repeated results; rows with a null id are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "bpe-blocks")
    store, root = open_store(folder)
    store.create_dir(root)
    asked = id_text(docs, id_col, text_col).mapInArrow(_split_blocks(tokenizer, folder, 2 * tasks(spark), block_chars), ASK)
    answers = asked.repartition(tasks(spark), "shard").mapInArrow(_answer(tokenizer), ASK)
    return live_with(answers.repartition(tasks(spark), "block").groupBy("block").applyInArrow(_join_back(tokenizer, folder), RESULT), folder)
