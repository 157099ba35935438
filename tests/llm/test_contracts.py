"""The opN_ queries on whole tables, digests included, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_edges import base_statistics
from tokenizers import Tokenizer

from corpusmill.llm import queries

EDGES = [None, "", " \n\t ", "Ein kurzer Text", "naïve café ☕ 日本語 <|endoftext|> <|im_start|>", "a" * 3000, "word " * 700, "Tab\tand\x0bfeed\x0c", "\u00a0no\u2028break", "İstanbul ǅ ﬁ"]


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """The driver's smallest tables with rows of every odd kind, and copies, after them."""
    root = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    first = {r["doc_id"]: r["text"] for r in docs.orderBy("doc_id").limit(4).collect()}
    texts = [*EDGES, *first.values(), *(t.upper() for t in first.values()), *(t[: len(t) // 2] + " und etwas anderes" for t in first.values())]
    more = spark.createDataFrame([(10_000 + i, t, None if i % 3 else "en", "src0", len(t or "")) for i, t in enumerate(texts)], docs.schema)
    docs.unionByName(more).repartition(3).write.parquet(f"{root}/documents.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    same = pages.orderBy("page_id").limit(3).selectExpr("page_id + 50000 AS page_id", "url", "html")
    odd = spark.createDataFrame([(60_000 + i, "http://x/", t) for i, t in enumerate(EDGES)], pages.schema)
    pages.unionByName(same).unionByName(odd).repartition(3).write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.fixture(scope="module")
def texts(tables):
    t = pq.read_table(f"{tables}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(sorted(zip(t["doc_id"], (x or "" for x in t["text"]), strict=True)))


def rows_of(spark, tables, name):
    return queries.queries()[name](spark, tables).collect()


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def word_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return {k: [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in texts.items()}


def test_op1(spark, tables, word_ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, tables, "op1_harmonic_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == word_ids.keys()
    for k, ids in word_ids.items():
        at = 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_op2(spark, tables, texts):
    tokens = {k: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", x.encode())] for k, x in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    count = Counter(w for k, t in tokens.items() if not held[k] for w in [*t, None])
    n, v = sum(count.values()), len(count)
    rows = rows_of(spark, tables, "op2_elias_fano_trigrams")
    assert sorted(r["doc_id"] for r in rows) == list(texts)
    for r in rows:
        own = [*tokens[r["doc_id"]], None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_op3(spark, tables):
    t = pq.read_table(f"{tables}/pages.parquet", columns=["page_id", "html"]).to_pydict()
    payload = {k: (x or "").encode() for k, x in zip(t["page_id"], t["html"], strict=True)}
    last = {x: max(k for k, y in payload.items() if y == x) for x in set(payload.values())}
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows_of(spark, tables, "op3_warc_segments")}
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    assert got == {k: (len(x), sha(x), "response" if last[x] == k else "revisit", None if last[x] == k else last[x]) for k, x in payload.items()}
    assert sum(x[2] == "revisit" for x in got.values()) >= 4


def test_op4(spark, tables, texts):
    seen, want = set(), {}
    for k, x in texts.items():
        raw = x.encode()
        own = [raw[i : i + 50] for i in range(len(raw) - 49)]
        gone = np.zeros(len(raw) + 1, bool)
        for i, w in enumerate(own):
            if w in seen:
                gone[i : i + 50] = True
        seen.update(own)
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if raw else 0
        want[k] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone[:-1], strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(spark, tables, "op4_two_stage_suffixes")}
    assert got == want


def test_op5(spark, tables, texts):
    rows = rows_of(spark, tables, "op5_mcd_outliers")
    assert sorted(r["doc_id"] for r in rows) == list(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_statistics(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_op6(spark, tables, texts):
    sets = {}
    for k, x in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", x.encode().lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {k: k for k in texts}
    keys = list(texts)
    for i, b in enumerate(keys):
        for a in keys[:i]:
            if label[a] != label[b] and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if x == high else x for k, x in label.items()}
    size = Counter(label.values())
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["kept"]) for r in rows_of(spark, tables, "op6_probminhash")}
    assert got == {k: (x, size[x], x == k) for k, x in label.items()}


def test_op7(spark, tables, word_ids):
    at, want = 0, {}
    for k, ids in word_ids.items():
        want[k] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, tables, "op7_mixing_coder")} == want


def test_op8(spark, tables, texts):
    norm = {k: x.encode().lower() for k, x in texts.items()}
    keep, size = {}, Counter(norm.values())
    for k, x in norm.items():
        keep[x] = max(keep.get(x, k), k)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows_of(spark, tables, "op8_extendible_dedup")}
    assert got == {k: (keep[x], size[x], keep[x] == k, hashlib.sha256(x).hexdigest()) for k, x in norm.items()}


def test_op10(spark, tables, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want = {}
    for k, x in texts.items():
        ids = t.encode(x, add_special_tokens=False).ids
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(spark, tables, "op10_word_table_bpe")} == want
