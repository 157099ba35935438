"""Token ids of whole texts by a word table: a text is split as the tokenizer's own
pre-tokenizer does, and only words that the table lacks go through the merges.

Texts with characters outside a range whose classes are the same in every
Unicode version, or with a special token's string, take the library's own path,
so the ids are those of ``Tokenizer.encode`` in every case.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import own_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters on which re's and the tokenizers' classes agree: ASCII, Latin-1 without
#: numeric signs and the no-break space, Latin Extended A and B, Cyrillic, common
#: punctuation.  Fixed values.
UNSAFE = re.compile("[^\t-\r -~¡-±´-¸ºº»¿-ɏЀ-ҁҊ-ԯ‐-‧‰-⁞]")
#: The word pattern of the lower-casing word-level vocabulary, on such characters.
WORD_END = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


class WordTable:
    """For vocabularies that lower-case, drop white space and mark word ends.

    The table's words are what stands between white space, as no pre-token spans two of them;
    the pre-tokenizer's pattern then only runs over new ones.  Texts are cut and words found by Arrow, so no Python runs for
    a word that the table has.  Where there are more than ``limit`` words, those that were not met again since the
    last such time leave, so that the common ones stay."""

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Tokenizer(self.tokenizer.model)  # for words that are normalised and split
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.limit = limit
        self._keep(pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True

    def plain(self, text: str) -> bool:
        if UNSAFE.search(text) or "<|" in text:
            return False
        return text.isascii() or ("\u0130" not in text and unicodedata.is_normalized("NFC", text))

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _keep(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The table's words, their ids one after the other, and how many of these each has."""
        self.words, self.ids, self.sizes, self.starts = words, ids, sizes, np.cumsum(sizes) - sizes
        self.met = np.zeros(len(words), bool)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One pass over many new words at once: ids, and how many each word has.  Each pre-token's ids end with a word-end piece."""
        parts = [[c] if c.isalpha() else WORD_END.findall(c) for c in words]
        flat = [x for p in parts for x in p]
        coded = self.merges.encode_batch_fast([" ".join(flat[i : i + 500]) for i in range(0, len(flat), 500)], add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, "<u4") for c in coded]) if coded else np.zeros(0, "<u4")
        ends = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
        last = np.cumsum([len(p) for p in parts])
        if len(ends) == last[-1] + 1:
            return ids, np.diff(ends[last], prepend=0)
        each = [np.frombuffer(self.direct(c), "<u4") for c in words]  # a piece that no word end closes
        return np.concatenate(each), np.array([len(e) for e in each], np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the table has distinct words; it learns those that it lacks."""
        if len(self.words) > self.limit:
            kept = np.flatnonzero(self.met)[-self.limit // 2 :]
            self._keep(self.words.take(pa.array(kept)), self.ids[runs(self.starts[kept], self.sizes[kept])], self.sizes[kept])
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        self.met[at[~new]] = True
        if new.any():
            lacking = words.filter(pa.array(new))
            ids, sizes = self._ids_of(lacking.to_numpy(zero_copy_only=False).tolist())
            at[new] = len(self.words) + np.arange(len(lacking))
            met = np.concatenate((self.met, np.zeros(len(lacking), bool)))
            self._keep(pa.concat_arrays([self.words, lacking]), np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes)))
            self.met = met
        return at

    def encode_batch(self, texts: list[str], group: int = 1000) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for lo in range(0, len(texts), group):
            part = texts[lo : lo + group]
            plain = [self.plain(t) for t in part]
            words = pc.ascii_split_whitespace(pa.array([t.lower() if p else "" for t, p in zip(part, plain, strict=True)], pa.large_string()))
            coded = words.values.dictionary_encode()
            at = self.places(coded.dictionary)[coded.indices.to_numpy()]
            sizes = self.sizes[at]
            raw = self.ids[runs(self.starts[at], sizes)].tobytes()
            edges = (np.concatenate(([0], np.cumsum(sizes)))[words.offsets.to_numpy()] * 4).tolist()
            out += [raw[a:b] if p else self.direct(t) for t, p, a, b in zip(part, plain, edges, edges[1:], strict=False)]
        return out


_tables: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """One table a worker process, kept between its tasks."""
    own_cache("word table", _tables.clear)
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]
