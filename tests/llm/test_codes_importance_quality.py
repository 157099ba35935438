"""Vector codes, importance resampling and the positive-unlabelled classifier against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusmill.llm import importance, pu_quality, queries, vector_codes

NAN, INF = float("nan"), float("inf")


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label), distinct ids; (id, code, error, label_error) of kept ones, and the digest."""
    rows = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in sorted(rows, key=lambda r: r[0]) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * d : p * d + d]
    books = [[cut(r[1], p) for r in rows[:entries]] for p in range(parts)]
    near = lambda x, b: min((sum((u - w) ** 2 for u, w in zip(x, c, strict=True)), k) for k, c in enumerate(b))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for r in rows:
                own.setdefault(near(cut(r[1], p), book)[1], []).append(cut(r[1], p))
            for k, xs in own.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by = [], Counter()
    for i, v, lab in rows:
        found = [near(cut(v, p), b) for p, b in enumerate(books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), lab))
        by[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return {i: (code, e, by[lab]) for i, code, e, lab in out}, sha


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, id string, code int, vector string"
    return spark.createDataFrame([(i, v, lab, "x", 7, None) for i, v, lab in rows], schema).repartition(3)


def test_codes_against_plain_python(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 1, 16).round(1)], int(rng.integers(3)) if i % 4 else None) for i in rng.permutation(150)]
    rows += [(200 + k, rows[0][1], 1) for k in range(60)]  # a large group of equal vectors
    odd = [(900, None, 1), (901, [NAN] * 16, 1), (902, [None] + [0.0] * 15, 1), (903, [INF] + [0.0] * 15, None), (None, [1.0] * 16, 1), (904, [1.0] * 8, 1), (905, [], 2)]
    want, sha = plain_codes(rows)
    got = vector_codes.vector_codes(vectors(spark, rows + odd)).collect()
    assert {r["id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want
    assert {r["books_sha256"] for r in got} == {sha} and len(got) == len(want)


def test_codes_of_huge_numbers_and_few_or_repeated_rows(spark):
    rows = [(i, [float(np.float32(x * 10.0 ** (i % 5 * 9))) for x in (1, -2, 3, 4, -5, 6, 7, 8)], None) for i in range(9)]
    want, sha = plain_codes(rows, rounds=2)
    got = vector_codes.vector_codes(vectors(spark, rows), rounds=2).collect()
    big = lambda e: e if e < 2**63 else None
    assert {r["id"]: (r["code"], r["error"]) for r in got} == {i: (c, big(e)) for i, (c, e, _) in want.items()}
    assert {r["books_sha256"] for r in got} == {sha}
    few = [(3, [0.5] * 8, 1), (3, [0.5] * 8, 1), (5, [0.25] * 8, None)]
    got = sorted((r["id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.vector_codes(vectors(spark, few)).collect())
    assert got == [(3, "00" * 8, 0, 0), (3, "00" * 8, 0, 0), (5, "01" * 8, 0, 0)]
    assert vector_codes.vector_codes(vectors(spark, few).limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.vector_codes(vectors(spark, [(1, [0.0] * 9, 1)]))


@pytest.mark.parametrize("kind", [np.int64, object])
def test_partial_distances_find_the_nearest(kind):
    rng = np.random.default_rng(3)
    for spread in (2, 50):  # few values give many ties
        parts, book = rng.integers(-spread, spread, (400, 6)).astype(kind), rng.integers(-spread, spread, (16, 6)).astype(kind)
        full = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
        code, least = vector_codes.nearest(parts, book)
        assert code.tolist() == np.argmin(full.astype(np.int64), axis=1).tolist() and least.tolist() == full.min(axis=1).tolist()


def test_dimensions_go_by_descending_variance():
    book = np.array([[0, 5, 1, 0], [0, -5, 1, 8], [0, 0, 2, 0]])
    assert vector_codes.search_order(book).tolist() == [1, 3, 2, 0]


def test_codes_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    sql = con.execute(queries.oracle_sql()["op11_partial_distance_codes"])
    cols = [c[0] for c in sql.description]
    got = queries.queries()["op11_partial_distance_codes"](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(sql.fetchall())


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_importance(docs, target, buckets=10000):
    """docs: (id, text) rows; (id, n_features, weight, score, rank), sorted."""
    cells = lambda t: Counter(zlib.crc32(f.encode()) % buckets for f in plain_features(t)[1])
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(cells(x))
    for x in target:
        t.update(cells(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    rows = []
    for i, x in docs:
        n, f = plain_features(x)
        w = sum(c * gain(b) for b, c in cells(x).items())
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def test_importance_of_the_tables(spark, sf):
    d, b = pq.read_table(f"{sf}/documents.parquet").to_pydict(), pq.read_table(f"{sf}/benchmark.parquet").to_pydict()
    got = queries.queries()["op12_csr_importance"](spark, sf).collect()
    want = plain_importance(list(zip(d["doc_id"], d["text"], strict=True)), b["text"])
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got), key=repr) == want
    assert sum(r["rank"] is not None for r in got) >= 5


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_importance_on_odd_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = [None, "", " .,-", "One", "two Words", "a_b^c`d{e~f\x7fg", "Ünï Ço日本 x" * 30, "w" * 5000, "aa bb " * 4000, *(f"k{i} " * 25 for i in range(40))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(8, texts[8])] * 2  # repeated rows
    frame = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in [*docs, (None, "no id")]], "doc_id long, text string, words string, id int, rank int").repartition(3)
    target = spark.createDataFrame([(t,) for t in ("k3 k3 k3", None, "Aa bB")], "text string")
    key = lambda out: sorted(((r["id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()), key=repr)
    assert key(importance.importance_sample(frame, target)) == plain_importance(docs, ["k3 k3 k3", "", "Aa bB"])
    assert key(importance.importance_sample(frame, target.limit(0))) == plain_importance(docs, [])
    assert importance.importance_sample(frame.limit(0), target).count() == 0


def test_features_of_a_text_in_pieces(monkeypatch):
    text = "Alpha beta-gamma delta. " * 300 + "ende"
    whole = importance.text_counts(text, 997, 3)
    monkeypatch.setattr(importance, "PIECE", 16)
    parts = importance.text_counts(text, 997, 3)
    n, f = plain_features(text)
    assert whole[:2] == parts[:2] == (n, len(f))
    want = Counter(zlib.crc32(x.encode()) % 997 for x in f)
    for found, counts in (whole[2:], parts[2:]):
        assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == want


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.queries()["op13_positive_unlabelled"](spark, folder).collect()}
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id"]).to_pydict()["doc_id"]
    assert sorted(got) == sorted(docs)
    lab = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    for r in got.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(got[i]["predicted"], q) for i, q in zip(lab["doc_id"], lab["quality"], strict=True) if got[i]["held_out"]]
    assert len(held) > 1000
    assert sum(p == 1 for p, q in held if q == 1) >= 0.99 * sum(q == 1 for _, q in held)
    assert sum(p == 0 for p, q in held if q == 0) >= 0.97 * sum(q == 0 for _, q in held)


def test_prior_and_risk():
    rng = np.random.default_rng(2)
    good, bad = (rng.normal(m, 1, (4000, 2)) for m in (1.5, -1.5))
    with_bias = lambda x: np.concatenate([x, np.ones((len(x), 1))], axis=1)
    pos, unl = with_bias(good[:2000]), with_bias(np.concatenate([good[2000:], bad[:1000]]))
    w = np.zeros(3)
    for r in range(6):
        w = pu_quality.descend(w, pos, unl, 2 / 3, 0.2, 60, 256, 1e-5, r)
    assert ((with_bias(good[2000:]) @ w) > 0).mean() > 0.95 and ((with_bias(bad) @ w) < 0).mean() > 0.95
    # the step is that of the risk's slope where the bound is idle, and of its negative part alone, turned, where not
    loss = lambda w, p: p * np.logaddexp(0, -(pos @ w)).mean() + np.logaddexp(0, unl @ w).mean() - p * np.logaddexp(0, pos @ w).mean()
    at, e = np.array([0.1, -0.2, 0.3]), 1e-6
    slope = [(loss(at + e * d, 0.4) - loss(at - e * d, 0.4)) / (2 * e) for d in np.eye(3)]
    assert np.allclose(pu_quality.risk_gradient(at, pos, unl, 0.4), slope, atol=1e-5)
    part = lambda w: np.logaddexp(0, unl @ w).mean() - 0.99 * np.logaddexp(0, pos @ w).mean()
    at = np.array([2.0, 2.0, 0.0])
    assert part(at) < 0
    slope = [(part(at + e * d) - part(at - e * d)) / (2 * e) for d in np.eye(3)]
    assert np.allclose(pu_quality.risk_gradient(at, pos, unl, 0.99), -np.array(slope), atol=1e-5)


def test_quality_on_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(90_000, None), (90_001, ""), (90_002, "word " * 300_000), (90_003, "\n\n"), (90_004, "é☕日"), (None, "no id")], docs.schema)
    frame = docs.unionByName(odd).unionByName(odd).selectExpr("*", "1 AS id", "'x' AS shard", "true AS positive")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    more = spark.createDataFrame([(None, 1, 0), (0, None, 0), (0, 0, 1), (123_456, 1, 0)], labels.schema)
    got = pu_quality.quality_scores(frame, labels.unionByName(more)).collect()
    assert len(got) == docs.count() + 10 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    none = pu_quality.quality_scores(frame, labels.limit(0), rounds=1).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    assert pu_quality.quality_scores(frame.limit(0), labels, rounds=1).count() == 0


def test_quality_takes_no_label_of_the_held_out_rows(spark, sf):
    """Turning every held-out label round changes no score, nor do negatives' labels."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b, c = (sorted((r["id"], r["score"]) for r in pu_quality.quality_scores(docs, x, rounds=2).collect()) for x in (labels, turned, labels.where("quality = 1")))
    assert a == b == c


def test_features_of_very_long_texts_in_pieces(monkeypatch):
    text = "Das ist ein Satz.\n" * 50
    whole = pu_quality.text_features(text)
    monkeypatch.setattr(pu_quality, "PIECE", 64)
    dims, _ = pu_quality.text_features(text)
    assert set(whole[0][whole[0] < pu_quality.CLASSES * (pu_quality.CLASSES + 1)]) <= set(dims)
