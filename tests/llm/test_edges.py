"""Every training-data operator on nulls, empty and long texts, ties, repeated rows, empty
tables and columns with clashing names; results against plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import bpe, common, efcodec, exact_dedup, html_text, idfiles, near_dedup, ngram_lm, packing, quality, substring_dedup, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, id string, row int, rep int, key string, n int, block string, shard string, data binary, kept string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefg" if seed == 1 else "abcdeéß", k=r.randint(1, 6))) for _ in range(n))


BASE = words(300, 1)
TEXTS = {
    0: None, 1: "", 2: "", 3: " \n\t", 4: "a", 5: BASE, 6: BASE.upper(), 7: BASE + " tail", 8: "x", 9: "X", 10: words(20000, 2), 11: "ÄÖ ß İstanbul don't <|endoftext|> 日本 ²½",
    12: "line\n" * 40, 13: BASE[:200] + words(50, 3) + BASE[200:500], 14: "=" * 500, 15: words(9, 4), 16: "a\x00b\x1cc\xa0d", 17: words(300, 5).replace("a", "#"),
}


def frame(spark, texts=None):
    rows = [(k, v, "en" if k % 2 else None, "s" if k % 3 else None, "x", 1, 2, "k", 3, "b", "s", b"d", "y") for k, v in (TEXTS if texts is None else texts).items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark, docs):
    """Each row twice, and one without an id."""
    return docs.unionByName(docs).unionByName(docs.limit(1).selectExpr("CAST(NULL AS long) AS doc_id", *[f"`{c}`" for c in docs.columns[1:]]))


def le(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def tokens():
    t = Tokenizer.from_file(WORD)
    return {k: [*t.encode(v or "", add_special_tokens=False).ids, 1] for k, v in TEXTS.items()}


# ------------------------------------------------------------------ packing


def check_pieces(rows, tokens, times):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids"] == le(tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert r["doc_tokens"] == len(tokens[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"]))
    for k, ids in tokens.items():
        covered = Counter(i for s, n in by_doc[k] for i in range(s, s + n))
        assert covered == Counter({i: times for i in range(len(ids))})
    for pieces in by_seq.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at == pieces[0][2]


def test_packing(docs, repeated, empty, tokens):
    check_pieces(packing.harmonic_packing(docs, WORD).collect(), tokens, 1)
    check_pieces(packing.harmonic_packing(repeated, WORD).collect(), tokens, 2)
    assert packing.harmonic_packing(empty, WORD).count() == 0


def test_cuts_fill_their_classes():
    for n in [*range(1, 3000), 4096, 100_001]:
        pieces = packing.cuts(n, 2048, 63)
        assert sum(p for p, _ in pieces) == n
        assert all(k * p <= 2048 and (k + 1) * p > 2048 for p, k in pieces if p <= 63)
        assert all(p == 2048 // k for p, k in pieces if p > 63)


# ----------------------------------------------------------- language model


def reference_scores(texts, held):
    toks = {k: [*(v or "").encode().lower().split(), "</s>"] for k, v in texts}
    c, two, three, ctx, succ = Counter(), Counter(), Counter(), Counter(), Counter()
    for k, t in toks.items():
        if not held(k):
            x = ["<s>", *t]
            c.update(t)
            ctx["<s>"] += 1
            two.update(zip(x, x[1:]))
            three.update(zip(x, x[1:], x[2:]))
    for w in c:
        ctx[w] = c[w]
    for v, _ in two:
        succ[v] += 1
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == i for x in c.values()) for i in (1, 2))
    d1 = n1 / (n1 + 2 * n2) if n1 else 0.0
    kept = {k: x for k, x in three.items() if x >= 2}
    left = Counter()
    for (a, b, _), x in kept.items():
        left[a, b] += (x - 0.75) / two[a, b]
    out = {}
    for k, t in toks.items():
        x, total = ["<s>", *t], 0.0
        for i, w in enumerate(t):
            p = (c[w] - d1) / n if w in c else max(d1 * v, 1) / n
            if succ[x[i]]:
                p = max(two[x[i], w] - 0.75, 0) / ctx[x[i]] + 0.75 * succ[x[i]] / ctx[x[i]] * p
            if i and two[x[i - 1], x[i]] >= 2:
                u = x[i - 1], x[i]
                p = (1 - left[u]) * p + ((kept[*u, w] - 0.75) / two[u] if (*u, w) in kept else 0)
            total += math.log10(p)
        out[k] = (held(k), len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), total)
    return out


def test_language_model(spark, docs, empty):
    rows = ngram_lm.score_documents(docs, block_chars=4000).collect()
    want = reference_scores(TEXTS.items(), ngram_lm.held_out)
    assert len(rows) == len(TEXTS)
    for r in rows:
        w = want[r["id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert abs(r["score"] - w[5]) <= 0.031 * r["n_tokens"]
    assert ngram_lm.score_documents(empty).count() == 0
    held = next(i for i in range(100) if ngram_lm.held_out(i))
    alone = ngram_lm.score_documents(frame(spark, {held: "a b"})).first()
    assert (alone["train_tokens"], alone["n_known"], alone["n_tokens"]) == (0, 0, 3)


def test_language_model_beats_unigrams_on_held_out_texts(spark, sf):
    rows = ngram_lm.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# --------------------------------------------------------------------- WARC


def check_archive(rows, payloads):
    lead = {}
    for k, v in payloads.items():
        lead[v] = max(lead.get(v, -1), k)
    assert len(rows) == len(payloads)
    for r in rows:
        v = payloads[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(v), base64.b32encode(hashlib.sha1(v).digest()).decode())
        first = lead[v] == r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", lead[v]))
        assert r["problem"] is None and (r["payload"] == v if first else r["payload"] is None)


def test_warc(docs, empty):
    out = warc.read_archives(warc.write_archives(docs, "doc_id", "source", "text", segment_bytes=700))
    check_archive(out.collect(), {k: (v or "").encode() for k, v in TEXTS.items()})
    assert warc.read_archives(warc.write_archives(empty, "doc_id", "source", "text")).count() == 0


def test_damaged_archives_give_problems(spark):
    texts = {i: f"<p>{i}</p>" * (200 if i % 2 else 3) for i in range(12)}
    manifest = warc.write_archives(frame(spark, texts).repartition(1), "doc_id", "source", "text", segment_bytes=700)
    main, more = (next(r for r in manifest.collect() if r["kind"] == kind) for kind in ("main", "more"))
    store, _ = common.open_store(main["folder"])

    def spoil(path, change):
        with store.open_input_file(path) as f:
            raw = f.read()
        with store.open_output_stream(path, compression=None) as f:
            f.write(change(raw))

    foreign = warc.record("response", "<urn:uuid:none>", b"HTTP/1.1 200 OK\r\n\r\nx")
    spoil(main["path"], lambda raw: raw + foreign + b"\x1f\x8b junk")
    spoil(more["path"], lambda raw: raw[:-40])
    rows = warc.read_archives(manifest).collect()
    good = {r["page_id"]: r["payload"] for r in rows if r["problem"] is None}
    assert all(good[i] == texts[i].encode() for i in good) and set(range(0, 12, 2)) <= set(good)
    assert sorted(r["page_id"] for r in rows if r["page_id"] is not None) == list(range(12)) and len(good) < 12
    assert sum(r["page_id"] is None for r in rows) == 2


def test_warc_damage():
    block = warc.HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload" * 10, 16)
    assert warc.http_payload(block)[0] == b"payload" * 10
    with pytest.raises(ValueError):
        warc.unchunk(b"10\r\nshort")
    parts = [(1, None, b"ab"), (3, 6, b"ef"), (2, None, b"cd"), (2, None, b"cd")]
    assert warc.reassemble(parts) == (b"abcdef", None)
    assert warc.reassemble(parts[:1])[1] and warc.reassemble([(1, None, b"ab"), (2, 5, b"cd")])[1] == "total length differs"
    assert warc.reassemble([(1, None, b"a"), (3, 3, b"b")])[1] and warc.reassemble([(1, None, b"a"), (1, 1, b"b")])[1]


# ------------------------------------------------------------ repeated bytes


def brute_repeats(texts):
    least, raw = {}, {k: (v or "").encode() for k, v in texts.items()}
    for k in sorted(raw):
        for i in range(len(raw[k]) - 49):
            least.setdefault(raw[k][i : i + 50], k)
    out = {}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\x01" * 50
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 2, "block_bytes": 900}])
def test_repeats(docs, options):
    got = {r["id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in substring_dedup.remove_repeats(docs, **options).collect()}
    assert got == brute_repeats(TEXTS)


def test_repeats_of_shared_passages(spark):
    r = random.Random(3)
    passages = ["".join(r.choices("ab c", k=90)) for _ in range(4)]
    texts = {i: "".join(r.choice([*passages, "x" * r.randint(0, 130), "é" * r.randint(0, 70), "".join(r.choices("abcdefgh", k=60))]) for _ in range(r.randint(0, 6))) for i in range(60)}
    d = frame(spark, texts)
    want = brute_repeats(texts)
    got = {x["id"]: (x["n_bytes"], x["n_removed"], len(x["spans"]), bytes(x["kept"])) for x in substring_dedup.remove_repeats(d, block_bytes=2000).collect()}
    assert got == want
    for x in substring_dedup.remove_repeats(d, whole_chars=True).collect():
        bytes(x["kept"]).decode()
        assert len(x["kept"]) >= len(want[x["id"]][3])


def test_repeats_edges(repeated, empty):
    rows = substring_dedup.remove_repeats(repeated).collect()
    assert len(rows) == 2 * len(TEXTS)
    want = brute_repeats(TEXTS)
    assert all((x["n_removed"], bytes(x["kept"])) == (want[x["id"]][1], want[x["id"]][3]) for x in rows)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_suffix_array():
    from corpusmill.llm.suffixes import adjacent_prefixes, suffix_array, words8

    r = random.Random(5)
    for _ in range(150):
        b = bytes(r.choices(range(r.choice([1, 2, 3, 256])), k=r.randint(1, 120)))
        t, want = np.frombuffer(b, np.uint8), sorted(range(len(b)), key=lambda i: b[i:])
        assert suffix_array(t).tolist() == want
        mask = np.array([r.random() < 0.4 for _ in b])
        assert suffix_array(t, wanted=mask).tolist() == [i for i in want if mask[i]]
        lcp = [0] + [next((k for k in range(50) if b[i + k : i + k + 1] != b[j + k : j + k + 1] or i + k >= len(b)), 50) for i, j in zip(want, want[1:])]
        assert adjacent_prefixes(words8(t), np.array(want), 50).tolist() == lcp


# ------------------------------------------------------------------ quality


def base_statistics(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, mark, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            mark |= set(range(i, i + 5))
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(mark), len(w) < 10 or 100 * len(mark) > 20 * len(w)


def test_quality(docs, repeated, empty):
    rows = quality.robust_quality(docs, steps=1).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_statistics(TEXTS[r["id"]])
        assert not (r["base_failed"] and r["kept"])
    assert quality.robust_quality(empty, steps=1).count() == 0
    assert quality.robust_quality(repeated, steps=1).count() == 2 * len(TEXTS)


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    texts = {i: words(100 + i % 150, i) for i in range(300)} | {1000 + i: words(100, i).replace("a", "#$%").replace("b", "|") for i in range(30)}
    rows = spark.createDataFrame([(k, v, "en", "s") for k, v in texts.items()], "doc_id long, text string, lang string, source string")
    kept = {r["id"]: r["kept"] for r in quality.robust_quality(rows).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(30))


def test_quality_rejects_an_outlier_of_each_coordinate(spark):
    r = random.Random(6)

    def prose(n, length=(3, 9)):
        return ["".join(r.choices("abcdefghij", k=r.randint(*length))) for _ in range(n)]

    texts = {i: " ".join(prose(100 + i % 50)) for i in range(300)}
    menu = " ".join(prose(3))
    texts |= {
        1000: " ".join(prose(20000)), 1001: " ".join(prose(120, (12, 18))), 1002: " ".join(prose(120)) + " " + "#" * 30,
        1003: " ".join(prose(60)) + "".join(f"\n{menu}\n" + " ".join(prose(6)) for _ in range(9)), 1004: " ".join([*(w := prose(110)), *w[:8]]) + f"\n{menu}" * 2,
    }
    rows = spark.createDataFrame([(k, v, "en", "s") for k, v in texts.items()], "doc_id long, text string, lang string, source string")
    got = {x["id"]: x for x in quality.robust_quality(rows).collect()}
    assert not any(x["base_failed"] for x in got.values())
    assert [k for k in range(1000, 1005) if got[k]["kept"]] == []
    assert sum(got[i]["kept"] for i in range(300)) >= 297


def plain_mcd(z):
    """Squared distances of the rows of z by a plain concentration from two starts."""
    floors, n = np.array(quality.FLOORS), len(z)

    def distance(m, s):
        low = np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                c = s[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(c, floors[i] ** 2)) if i == j else c / low[j, j]
        return (np.linalg.solve(low, (z - m).T) ** 2).sum(axis=0), 2 * np.log(np.diag(low)).sum()

    centre = np.median(z, axis=0)
    scale = np.maximum(1.4826 * np.median(abs(z - centre), axis=0), floors)
    u = (z - centre) / scale
    u /= np.maximum(np.linalg.norm(u, axis=1), 1e-9)[:, None]
    best = (np.inf, None)
    for start in (np.diag(scale**2), np.outer(scale, scale) * (5 * u.T @ u / n)):
        d, det = distance(centre, start)[0], np.inf
        while True:
            near = z[np.argsort(d, kind="stable")[: int(np.ceil(0.75 * n))]]
            after, now = distance(near.mean(axis=0), np.cov(near.T, bias=True))
            if now >= det - quality.SETTLED:
                break
            d, det = after, now
        best = min(best, (det, d), key=lambda x: x[0])
    d = best[1]
    within = z[d <= max(np.median(d) / quality.chi2_quantile(0.5, 5), 1) * quality.chi2_quantile(0.975, 5)]
    return distance(within.mean(axis=0), np.cov(within.T, bias=True))[0]


def test_quality_is_that_of_a_plain_estimate(spark):
    r = random.Random(9)
    texts = {}
    for i in range(1200):
        w = words(int(2 ** r.uniform(4, 9)), i).split(" ")
        if i % 10 == 0:
            w = ["#" * r.randrange(1, 9) + x if r.random() < 0.3 else x for x in w]
        if i % 9 == 0:
            w += ["\n" + " ".join(w[:4])] * r.randrange(1, 6)
        if i % 31 == 0:
            w = [x * r.randrange(1, 4) for x in w]
        texts[i] = " ".join(w)
    # two sources with enough rows, one language whose small sources are enough together, and a few others
    place = lambda i: ("en", "a") if i < 700 else ("fr", "b") if i < 1100 else ("de", str(i % 9)) if i < 1190 else ("es", "c")
    rows = spark.createDataFrame([(k, v, *place(k)) for k, v in texts.items()], "doc_id long, text string, lang string, source string")
    got = {x["id"]: x for x in quality.robust_quality(rows).collect()}
    z = {i: (math.log1p(n), math.log((c + 100) / (n + 20)), math.log1p(100 * s / max(c, 1)), math.log1p(10 * d / max(1, sum(bool(x.split()) for x in texts[i].split("\n")))), math.log1p(10 * q / max(n, 1))) for i, (n, c, s, d, q, _) in ((i, base_statistics(t)) for i, t in texts.items())}
    cutoff, seen = quality.chi2_quantile(1 - 1e-5, 5), Counter()
    for level, lo, hi in ((0, 0, 700), (0, 700, 1100), (1, 1100, 1190), (3, 1190, 1200)):
        own = [i for i in range(lo, hi) if not got[i]["base_failed"]]
        assert {got[i]["level"] for i in own} == {level}
        if level == 3:
            assert all(got[i]["kept"] and got[i]["distance2"] is None for i in own)
            continue
        for i, d in zip(own, plain_mcd(np.array([z[i] for i in own])), strict=True):
            assert math.isclose(got[i]["distance2"], d, rel_tol=0.3, abs_tol=0.5), (i, d, got[i])
            assert abs(d - cutoff) < 6 or got[i]["kept"] == (d <= cutoff)
            seen[bool(d <= cutoff)] += 1
    assert seen[False] > 50 and seen[True] > 800


def test_quality_runs_no_python(docs):
    plan = quality.robust_quality(docs, steps=1)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---------------------------------------------------------- near duplicates


def test_near_duplicates(docs, repeated, empty):
    rows = {r["id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert len(rows) == len(TEXTS)
    assert rows[5]["class_id"] == rows[6]["class_id"] == rows[7]["class_id"] == 5 and rows[5]["class_size"] == 3
    assert rows[8]["class_id"] == rows[9]["class_id"] == 8
    for k in (0, 1, 2, 3, 10, 11, 13, 17):
        assert rows[k]["class_id"] == k
    assert near_dedup.near_duplicates(repeated).where("id = 5 AND class_size = 6").count() == 2
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_match_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {}
    for r in d.collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(d).collect()} == {k: find(k) for k in keys}


def template_family(members, pairs, slots=20, values=3):
    """Texts of one template with a word of few in each slot, no two of them alike (five slots
    differ, J <= 0.78), and after them pairs that differ in four slots (J = 0.82)."""
    r = np.random.default_rng(8)
    own = np.zeros((0, slots), np.int64)
    while len(own) < members + 2 * pairs:
        x = r.integers(0, values, (1, slots))
        if len(own) >= members:
            x = np.vstack((x, x))
            x[1, :4] = (x[1, :4] + 1) % values
        if ((own[:, None] != x).sum(axis=2) > 4).all():
            own = np.vstack((own, x))
    base = [f"w{i}" for i in range(208)]
    texts = {}
    for i, x in enumerate(own):
        w = list(base)
        w[7:207:10] = [f"v{k}" for k in x]
        texts[i] = " ".join(w)
    return texts


def test_near_copies_in_a_large_template_family(spark):
    d = frame(spark, template_family(1200, 40))
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(d).collect()}
    assert got == {i: i for i in range(1200)} | {i: i - i % 2 for i in range(1200, 1280)}


def test_repeated_passages_do_not_hide_near_copies(spark):
    texts = {}
    for i in range(30):
        w = [f"{i}x{k}" for k in range(110)]
        texts[2 * i], texts[2 * i + 1] = " ".join(w), " ".join([*w, *w[:30] * 200])
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {k: k - k % 2 for k in texts}


@pytest.mark.parametrize("most", [1, 7, 2048])
def test_every_two_members_of_a_bucket_meet_once(spark, most):
    d = spark.createDataFrame([(k % 3, k) for k in range(60)], "bucket long, rep long")

    def run(batches):
        for cell in near_dedup._cells(batches):
            x = cell.to_pylist()
            pairs = [(a["rep"], b["rep"]) for a in x for b in x if a["rep"] != b["rep"] and (a["block"], b["block"]) == (a["i"], a["j"]) and (a["i"] < a["j"] or a["rep"] < b["rep"])]
            yield pa.RecordBatch.from_pylist([{"a": min(p), "b": max(p)} for p in pairs], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    met = [tuple(r) for r in near_dedup._dealt(d, F.lit(1), most).mapInArrow(run, "a long, b long").collect()]
    assert sorted(met) == [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3]


def test_cell_links_lose_none():
    r = random.Random(4)
    base = [list(range(100 * k, 100 * k + n)) for k, n in enumerate((1, 4, 9, 10, 30, 60))]
    sets = [sorted({x if r.random() > 0.08 else r.randrange(10**6) for x in r.choice(base)}) for i in range(150)]
    links = near_dedup.cell_links([np.array(s, np.uint64) for s in sets], [(a, np.arange(a + 1, 150)) for a in range(149)], 0.8)
    want = {(a, b) for a in range(150) for b in range(a) if 10 * len({*sets[a]} & {*sets[b]}) >= 8 * len({*sets[a]} | {*sets[b]})}

    def classes(pairs):
        label = list(range(150))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i in range(150) if label[i] == x) for x in label}

    assert want and classes(links) == classes(want) and len(links) == 150 - len(classes(want))


def test_signatures_estimate_the_similarity():
    from corpusmill.llm.shingles import mix

    x = mix(np.arange(2000, dtype=np.uint64))
    sig = near_dedup.signatures([x[:1000], x[100:1100], x[:1000][::-1], x[:0], x[:1]], 512)
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.08
    assert (sig[0] == sig[2]).all() and not sig[3].any()


def probability_jaccard(x, y):
    """By its definition; x and y: counts by element."""
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in {*x} & {*y}) if x and y else 0.0


def as_arrays(c):
    keys = sorted(c)
    return np.array(keys, np.uint64), np.array([c[k] for k in keys])


def test_probability_jaccard_is_that_of_the_definition():
    from corpusmill.llm import shingles

    r = random.Random(6)
    for n in (1, 2, 9, 60):
        for most in (1, 3, 50):
            x, y = ({r.randrange(80): r.randint(1, most) for _ in range(n)} for _ in range(2))
            assert abs(shingles.probability_jaccard(*as_arrays(x), *as_arrays(y)) - probability_jaccard(x, y)) < 1e-9
    assert shingles.probability_jaccard(*as_arrays({1: 2, 5: 4}), np.array([1, 5], np.uint64), np.array([1, 2])) == pytest.approx(1)
    assert shingles.probability_jaccard(np.zeros(0, np.uint64), None, np.zeros(0, np.uint64), None) == 0


def test_signatures_weigh_repeats():
    """Registers agree as often as the probability Jaccard similarity of the counts says, and weights' scale doesn't matter."""
    from corpusmill.llm.shingles import mix

    x = mix(np.arange(600, dtype=np.uint64))
    r = np.random.default_rng(3)
    a, b = np.repeat(np.arange(500), r.integers(1, 30, 500)), np.repeat(np.arange(100, 600), r.integers(1, 30, 500))
    heavy = np.concatenate((np.arange(300), np.repeat(np.arange(40), 60)))
    sig = near_dedup.signatures([x[a], x[b], np.tile(x[a], 3), x[heavy], x[np.unique(heavy)], x[a]], 2048)
    want = probability_jaccard(Counter(a.tolist()), Counter(b.tolist()))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04 and (sig[0] == sig[2]).all()
    assert abs((sig[3] == sig[4]).mean() - probability_jaccard(Counter(heavy.tolist()), Counter(range(300)))) < 0.04
    plain = near_dedup.signatures([x[a], x[np.unique(a)], x[a]], 512, 1)
    assert (plain[0] == plain[1]).all() and not (plain[0] == plain[2]).all()


def linked_by_weights(x, y):
    a, b = ({tuple(w[i : i + 5]): 0 for i in range(max(1, len(w) - 4))} if w else {} for w in (x, y))
    for w, c in ((x, a), (y, b)):
        for i in range(max(1, len(w) - 4) if w else 0):
            c[tuple(w[i : i + 5])] += 1
    return 10 * len({*a} & {*b}) >= 8 * len({*a} | {*b}) > 0 or probability_jaccard(a, b) >= 0.8


def weighted_texts(families=24, seed=9):
    """Texts that repeat a passage, with other ends: alike by counts, by sets, by both or by neither."""
    r, texts = random.Random(seed), {}
    for f in range(families):
        core, times = [f"{f}c{k}" for k in range(20)], r.choice((1, 2, 6, 20))
        for _ in range(3):
            tail = [f"{f}t{r.randrange(10**6)}" for _ in range(r.choice((4, 10, 40)))]
            texts[len(texts)] = " ".join([*core * max(1, times + r.choice((0, 0, -1, 12))), *tail])
    return texts


def test_near_duplicates_by_counts_match_brute_force(spark):
    texts = weighted_texts()
    split = [t.split() for t in texts.values()]
    label = list(range(len(split)))
    by_counts = 0
    for b in range(len(split)):
        for a in range(b):
            if split[a][0] == split[b][0] and linked_by_weights(split[a], split[b]):
                x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (split[a], split[b]))
                by_counts += 10 * len(x & y) < 8 * len(x | y)
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert by_counts >= 5 and len(set(label)) > 30 and got == dict(enumerate(label))


def test_cell_links_weigh_counts():
    r = random.Random(5)
    core = [{k * 100 + i: r.choice((1, 1, 30)) for i in range(25)} for k in range(4)]
    sets = []
    for _ in range(80):
        c = dict(r.choice(core))
        for k in r.sample(sorted(c), 4):
            c[k] = r.choice((1, 30))
        for _ in range(r.choice((0, 3, 12))):
            c[r.randrange(10**6, 10**7)] = 1
        sets.append(c)
    arrays = [as_arrays(c) for c in sets]
    counts = [c if c.max() > c.min() else None for _, c in arrays]
    links = near_dedup.cell_links([s for s, _ in arrays], [(a, np.arange(a + 1, 80)) for a in range(79)], 0.8, counts)
    alike = lambda x, y: 10 * len({*x} & {*y}) >= 8 * len({*x} | {*y}) or probability_jaccard(x, y) >= 0.8
    own, want = list(range(80)), list(range(80))
    for label, pairs in ((own, links), (want, [(a, b) for b in range(80) for a in range(b) if alike(sets[a], sets[b])])):
        for a, b in pairs:
            low, high = sorted((label[a], label[b]))
            label[:] = [low if x == high else x for x in label]
    assert own == want and len(links) == 80 - len(set(want)) > 10


def test_components_of_a_long_chain(spark):
    from corpusmill.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


# ------------------------------------------------------------ id files, BPE


def test_id_files(docs, repeated, empty, tokens):
    rows = idfiles.read_id_files(idfiles.write_id_files(docs, WORD, file_ids=2000)).collect()
    at = 0
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(TEXTS)
    for k in sorted(TEXTS):
        assert (by[k]["start"], by[k]["n_tokens"], by[k]["ids"]) == (at, len(tokens[k]), le(tokens[k]))
        at += len(tokens[k])
    assert idfiles.read_id_files(idfiles.write_id_files(repeated, WORD)).count() == 2 * len(TEXTS)
    assert idfiles.read_id_files(idfiles.write_id_files(empty, WORD)).count() == 0


def test_mixing_coder_round_trips_and_finds_damage():
    from corpusmill.llm import mixcoder as m

    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.ones(1), np.zeros(5000), np.arange(3000) * 7919, np.arange(150_000) * 17, rng.integers(0, 2**32, 900), rng.zipf(1.5, 20000) % 50000, np.tile(np.arange(50), 200)):
        ids = ids.astype(np.uint32)
        data = m.pack_file(np.array([3]), np.array([len(ids)]), ids)
        assert (m.unpack_file(data)[2] == ids).all()
    # repeating ids: well under what their own frequencies would cost
    assert len(data) * 8 < 0.5 * len(ids) * np.log2(50)
    for at in (2, 20, 16 + int.from_bytes(data[8:12], "little")):  # magic, header, first block
        broken = bytearray(data)
        broken[at] ^= 0xFF
        with pytest.raises(ValueError):
            m.unpack_file(bytes(broken))


def test_each_block_is_decoded_alone_and_its_order_0_adapts():
    from corpusmill.llm import mixcoder as m

    rng = np.random.default_rng(2)
    # ids of two parts of the vocabulary by turns: what one block learns is no use to the next
    ids = np.concatenate([rng.permutation(49_000)[:300][rng.integers(0, 300, 2000)] for _ in range(4)]).astype(np.uint32)
    words, sizes = m.encode(ids, 2000, [6, 5, 5])
    ends = np.cumsum(sizes)
    for k in range(4):
        assert (m.decode(words[ends[k] - sizes[k] : ends[k]], sizes[k : k + 1], 2000, 2000, [6, 5, 5]) == ids[2000 * k : 2000 * k + 2000]).all()
    assert 16 * len(words) < 0.85 * len(ids) * np.log2(49_000)
    same = np.concatenate([ids[:2000]] * 2)
    one, two = m.encode(same, 2000, [6, 5, 5])[1]
    assert one == two  # reset


def test_byte_bpe(docs, repeated, empty):
    t = Tokenizer.from_file(BYTE)
    rows = bpe.encode_decode(docs, BYTE, block_chars=3000).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), le(ids), t.decode(ids, skip_special_tokens=False))
    assert bpe.encode_decode(repeated, BYTE).count() == 2 * len(TEXTS)
    assert bpe.encode_decode(empty, BYTE).count() == 0


def test_words_are_encoded_as_the_library_does():
    from corpusmill.llm.words import WordTable

    w, b, lib = WordTable(WORD, limit=50), bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    r = random.Random(2)
    alphabet = list("ab .,'!_-\n\t 12²é́ÉßİΣς日😀\x85\xa0\x1c|<>#") + ["'s", "'ll", "<|endoftext|>", "  ", "...", ",,"]
    for _ in range(400):
        t = "".join(r.choices(alphabet, k=r.randint(0, 25)))
        assert w.encode_batch([t])[0] == w.direct(t), repr(t)
        assert [i for x in b.encode(b.split(t)) for i in np.frombuffer(x, "<u4").tolist()] == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_short_rest_has_no_file_of_its_own(spark):
    docs = spark.createDataFrame([(k, "a " * 99) for k in range(42)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        manifest = idfiles.write_id_files(docs, WORD, file_ids=1000)
        assert [(r["base"], r["n_ids"]) for r in manifest.orderBy("base").collect()] == [(0, 1000), (1000, 1000), (2000, 1000), (3000, 1200)]
        rows = sorted(idfiles.read_id_files(manifest).collect(), key=lambda r: r["doc_id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in rows] == [(k, 100 * k, 100) for k in range(42)]


def test_passages_far_apart_are_guessed():
    from corpusmill.llm import mixcoder as m

    rng = np.random.default_rng(3)
    passages = rng.integers(0, 3000, (4000, 20))
    ids = passages[rng.integers(0, 4000, 20_000)].ravel().astype(np.uint32)
    data = m.pack_file(np.array([1]), np.array([len(ids)]), ids)
    assert (m.unpack_file(data)[2] == ids).all()
    assert 8 * len(data) < 0.7 * len(ids) * np.log2(3000)


@pytest.mark.parametrize("top", [60, 70_000, 1 << 21, (1 << 32) - 1])
def test_blocks_of_several_lanes_and_ids_of_any_size(top):
    from corpusmill.llm import mixcoder as m

    rng = np.random.default_rng(4)
    for n in (1, 2, 1023, 2049, 3 * 1024 + 1, 9000):
        ids = (rng.zipf(1.3, n) * 2654435761 % (top + 1)).astype(np.uint32)
        words, sizes = m.encode(ids, 4000, m.widths_of(top))
        assert (m.decode(words, sizes, n, 4000, m.widths_of(top)) == ids).all()
        assert len(sizes) == -(-n // 4000)


def test_a_word_is_encoded_once_while_the_table_has_it(monkeypatch):
    from corpusmill.llm.words import WordTable

    w, asked, r = WordTable(WORD, limit=60), [], random.Random(5)
    learn = w._ids_of
    monkeypatch.setattr(w, "_ids_of", lambda words: (asked.extend(words), learn(words))[1])
    assert w.encode_batch(["a b a, b.", "", "  b\n"]) == [w.direct(t) for t in ("a b a, b.", "", "  b\n")]
    assert w.encode_batch(["b a,", "a b."], group=1) == [w.direct(t) for t in ("b a,", "a b.")]
    assert len(asked) == len(set(asked))
    for _ in range(60):  # words beyond the limit leave; those met again stay
        texts = [" ".join(["a", *(r.choice("xyzü") + str(r.randint(0, 300)) for _ in range(9))]) for _ in range(4)]
        assert w.encode_batch(texts) == [w.direct(t) for t in texts]
        assert len(w.words) <= 60 + 37
    assert asked.count("a") == 1


# --------------------------------------------------------------- exact copies


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_exact_dedup(docs, bits):
    rows = {r["id"]: r for r in exact_dedup.extendible_dedup(docs, hash_bits=bits, bucket_capacity=2, chunk_rows=3).collect()}
    groups = defaultdict(list)
    for k, v in TEXTS.items():
        groups[(v or "").encode().lower()].append(k)
    assert len(rows) == len(TEXTS)
    for norm, ids in groups.items():
        for k in ids:
            r = rows[k]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), k == max(ids), hashlib.sha256(norm).hexdigest())


def test_exact_dedup_edges(repeated, empty):
    rows = exact_dedup.extendible_dedup(repeated).collect()
    assert len(rows) == 2 * len(TEXTS) and sum(r["kept"] for r in rows) == len({(v or "").encode().lower() for v in TEXTS.values()})
    assert exact_dedup.extendible_dedup(empty).count() == 0


def test_extendible_hash_splits():
    h = exact_dedup.ExtendibleHash(4)
    r = random.Random(1)
    keys = [r.getrandbits(64) for _ in range(500)] + [77] * 20
    for k in keys:
        h.insert((k,))
    held = [e for b in h.buckets() for e in b[1]]
    assert sorted(e[0] for e in held) == sorted(keys) and h.depth > 3
    assert all(e in h.directory[e[0] & ((1 << h.depth) - 1)][1] for e in held)


# --------------------------------------------------------------------- HTML


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
    ("<table><tr><td>apple<td>1<tr><td>fig<td>22</table>", "apple  1\nfig    22"), ("<b hidden>x</b>y<span style='display: none'>z</span>", "y"),
    ("<style>.h{display:none}</style><i class='h k'>x</i>y", "y"), ("<pre>a\n  b</pre>", "a\n  b"), ("<script>var a='</p>';</script>t", "t"), ("<title>t</title>x", "x"),
    ("a<br>b", "a\nb"), ("<!-- c -->x<!-- open", "x"), ("1 < 2", "1 < 2"), ("<p>a <b>b</b> c</p>", "a b c"), ("<details><summary>s</summary>h</details>", "s"),
])
def test_html(page, text):
    assert html_text.html_text(page) == text


@pytest.mark.parametrize(("css", "body", "text"), [
    ("@media print{.m{display:none}}", "<p class=m>x", "x"), ("@media (max-width:600px){p{display:none}}", "<p>x", "x"),
    ("@media screen and (min-width: 50em){p{display:none}}", "<p>x</p>y", "y"), ("@media (400px<=width<=2000px){p{display:none}}", "<p>x</p>y", "y"),
    ("@media not print{p{display:none}}", "<p>x</p>y", "y"), ("@media (unheard-of){p{display:none}}", "<p>x", "x"),
    (".a{display:none}.a{display:block}", "<p class=a>x", "x"), (".a{display:block}.a{display:none}", "<p class=a>x</p>y", "y"),
    ("#i{display:none}.a{display:block}", "<p class=a id=i>x</p>y", "y"), (".a{display:none!important}", "<p class=a style='display:block'>x</p>y", "y"),
    ("@layer b{#i{display:none}}.a{display:block}", "<p class=a id=i>x", "x"), (".a{visibility:hidden}.b{visibility:visible}", "<div class=a>x<p>y<b class=b>z</b></p></div>", "z"),
    (".a{display:none}", "<div class=a><p style='display:block'>x</p></div>y", "y"), ("div.x>p{display:none}", "<div class=x><p>a</p><b><p>b</p></b></div>", "b"),
    (".y p{display:none}", "<div class=y><b><p>c</p></b></div><p>d", "d"), ("p+p,a:hover{display:none}", "<p>c<p><a>d</a>", "c\n\nd"),
    ("[data-x='1']{display:none}", "<i data-x=1>a</i><i data-x=2>b</i>", "b"), ("/* } */ .q{content:'}';display:none}", "<i class=q>l</i>m", "m"),
    ("", "<p hidden style='display:block'>x", "x"), ("li{visibility:hidden}", "<ol><li>a<li style='visibility:visible'>b</ol>", "2. b"),
    ("", "<svg><defs><text>n</text></defs><title>t</title><path d=x /><text>one <tspan>two</tspan></text>z</svg>w", "one two\nw"),
    ("", "<object data=x><param name=a>f</object>", "f"), ("", "<input value=v><input placeholder=h><input type=password value=s><input type=hidden value=q>", "v h"),
    (".a .b,.a > .c", "<p class=a>x", "x"), ("p{display:none", "<p>x</p>y", "y"),
])
def test_html_styles(css, body, text):
    assert html_text.html_text(f"<style>{css}</style>{body}") == text
    assert html_text.html_text(f"<style media=print>{css}</style><i>{text.split()[-1]}</i>") == text.split()[-1]


@pytest.mark.parametrize(("css", "body", "text"), [
    ("span{display:block}", "<p>a<span>b</span>c", "a\nb\nc"), ("p{display:inline}", "a<p>b</p>c", "abc"), ("div{display:inline-block}", "<div>a</div> <div>b</div>", "a b"),
    ("li{display:inline}", "<ul><li>a <li>b</ul>c", "a b\n\nc"), ("li{display:block}", "<ol><li>a<li style='display:list-item'>b</ol>", "a\n1. b"), ("b{display:list-item}", "<b>a</b><b>c</b>", "- a\n- c"),
    ("b{display:nonsense}", "a<b>b</b>", "ab"), ("i{display:block flow}", "a<i>b</i>", "a\nb"), ("i{display:inline flex}", "a<i>b</i>", "ab"), ("div{display:initial}", "a<div>b</div>c", "abc"),
    (".t{display:table}.r{display:table-row}.c{display:table-cell}", "<div class=t><div class=r><div class=c>a</div> <div class=c>b</div></div><div class=r><div class=c>ccc</div><div class=c>d</div></div></div>", "a    b\nccc  d"),
    (".t{display:table}.c{display:table-cell}", "<div class=t><div class=c>a</div><div class=c>b</div></div>", "a  b"), (".c{display:table-cell}", "<div><span class=c>a</span><span class=c>b</span></div>", "a b"),
    ("td{display:block}", "<table><tr><td>a<td>b</table>", "a\nb"), ("[title='a,b'],i{display:none}", "<b title='a,b'>x</b><i>y</i>z", "z"), ("b:not(i,u),p{display:none}", "<b>x</b><p>y", "x"),
    ("blockquote{display:inline}", "<blockquote>a</blockquote>b", "ab"), ("q{display:block}p{display:revert}", "<p>x</p><p>y", "x\n\ny"),
    ("", "<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"), ("", "<ol reversed><li>a<li>b<li value=9>c<li>d</ol>", "4. a\n3. b\n9. c\n8. d"), ("", "<ol type=a start=26><li>a<li>b</ol>", "z. a\naa. b"),
    ("", "<ol type=I><li>a<li type=i>b<li value=1994>c<li value=0>d</ol>", "I. a\nii. b\nMCMXCIV. c\n0. d"), ("", "<ol start=x><li value=>a</ol>", "1. a"),
])
def test_html_display_and_numbers(css, body, text):
    assert html_text.html_text(f"<style>{css}</style>{body}") == text


@pytest.mark.parametrize("depth", [1, 21, 60, 120])
def test_html_tables_in_tables_keep_their_columns(depth):
    page = "<table><tr><td>a<td>" * depth + "x" + "</table>" * depth
    assert html_text.html_text(page) == "a  " * depth + "x"


class Plain(HTMLParser):
    """The words of a page's text nodes in their order, but for those of elements that are never shown."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.closed = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "template", "noscript", "iframe", "head"):
            self.closed.append(tag)

    def handle_endtag(self, tag):
        if tag in self.closed:
            del self.closed[self.closed.index(tag) :]

    def handle_data(self, data):
        if not self.closed:
            self.out += data.split()


def test_html_whole_table_against_another_parser(spark, sf):
    """Every word of every page that another parser gives is there as often, unless an element is hidden by its attributes or a style."""
    rows = html_text.extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert got.keys() == pages.keys()
    compared = 0
    for k, page in pages.items():
        if re.search(r"hidden|display|visibility|<(?:input|textarea|select|ol|q|details|dialog|svg|math|object|audio|video)\b", page, re.I):
            continue
        parser = Plain()
        parser.feed(page)
        parser.close()
        compared += 1
        signs = {"-", ">", "---"}
        assert Counter("".join(w for w in parser.out if w not in signs)) == Counter("".join(w for w in got[k].split() if w not in signs)), k
    assert compared


def test_html_damaged_pages_take_linear_time():
    nested = "<style>" + "".join(f".a .b{i}{{display:none}}" for i in range(300)) + "</style>" + "<div class='b a'>" * 20000
    for page in (nested, "<style>" + "/*" * 50000, "<style>" + "[x" * 50000, "<style>@media " + "(" * 50000 + "{", "<style>p{display:" + "a " * 50000 + "1}", "<style>p" + " > " * 20000 + "{display:none}",
                 '<a "' * 20000, "<" * 50000, "<!--" * 20000, "<div>" * 30000, "<table>" * 3000 + "x", "<li>" * 20000, "<a b='" * 20000, "<style>" + "a{" * 20000):
        html_text.html_text(page)


def test_html_frame(docs, repeated, empty):
    rows = html_text.extract_text(docs, "doc_id", "text").collect()
    assert {r["page_id"]: r["text"] for r in rows} == {k: html_text.html_text(v or "") for k, v in TEXTS.items()}
    assert html_text.extract_text(repeated, "doc_id", "text").count() == 2 * len(TEXTS) and html_text.extract_text(empty, "doc_id", "text").count() == 0


# ------------------------------------------------------------ monotone sequences


def test_elias_fano_reads_and_successors():
    r = np.random.default_rng(3)
    dense, sparse = np.arange(5000), np.sort(r.integers(0, 1 << 50, 700))
    bursts = np.sort(np.concatenate([r.integers(0, 1 << 44, 50), (1 << 43) + np.arange(3000), np.full(200, 7)]))
    for x in ([], [0], [1 << 56], [0] * 300, dense, dense * 64, sparse, bursts):
        x = np.asarray(x, np.uint64)
        raw = np.frombuffer(b"\x00" * 3 + efcodec.EliasFano.of(x).dump(), np.uint8)  # not aligned
        e, end = efcodec.EliasFano.load(raw, 3)
        assert end == len(raw) and (e.at(np.arange(len(x))) == x).all()
        if len(x):
            i = r.integers(0, len(x), 2000)
            lo, hi = np.maximum(i - 20, 0), np.minimum(i + 20, len(x))
            v = x[i] + r.integers(0, 3, 2000).astype(np.uint64)
            place, equal = e.find(v, lo, hi)
            assert (e.at(i) == x[i]).all() and (place == np.clip(np.searchsorted(x, v), lo, hi)).all()
            assert (equal == ((place < hi) & (x[np.minimum(place, len(x) - 1)] == v))).all()
            j = np.arange(len(x) - 1)
            first, second = e.pairs(j)
            assert (first == x[:-1]).all() and (second == x[1:]).all()


def test_select_in_words():
    r = np.random.default_rng(4)
    for word in [1, 1 << 63, (1 << 64) - 1, *map(int, r.integers(1, 1 << 63, 200, dtype=np.uint64))]:
        places = [b for b in range(64) if word >> b & 1]
        got = efcodec.select_in_words(np.full(len(places), word, np.uint64), np.arange(len(places), dtype=np.uint64))
        assert got.tolist() == places
