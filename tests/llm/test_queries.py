"""The contract's queries and the pipeline."""

from __future__ import annotations

import itertools
import random
import time

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import common, queries
from corpusmill.llm.common import stored, sweep


def test_names_and_oracles():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)


def test_exact_dedup_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    sql = con.execute(queries.oracle_sql()["op8_extendible_dedup"])
    cols = [c[0] for c in sql.description]
    got = queries.queries()["op8_extendible_dedup"](spark, sf)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(sql.fetchall())


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes]
        after = after.cache()
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids and ids <= {r["doc_id"] for r in before.select("doc_id").collect()}, name
        if name == "exact_duplicates":
            assert after.selectExpr("count(DISTINCT text) = count(*)").first()[0]
        if name != "repeated_passages":
            assert after.selectExpr("doc_id", "text AS now").join(docs, "doc_id").where("now <> text").count() == 0
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.collect()}


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := lowered(t).split(" ")) != [""] else set() for t in (a, b)]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def lowered(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def brute_pipeline(rows):
    """(id, text) after each stage from the second on; texts of single spaces."""
    exact = {}
    for i, t in rows:
        exact[lowered(t)] = max(exact.get(lowered(t), (i, t)), (i, t))
    yield (kept := sorted(exact.values()))
    label = list(range(len(kept)))
    for b in range(len(kept)):
        for a in range(b):
            if label[a] != label[b] and jaccard(kept[a][1], kept[b][1]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    yield (kept := [kept[i] for i in sorted(set(label))])
    seen, out = set(), []
    for i, t in kept:
        raw = t.encode()
        own = [raw[k : k + 50] for k in range(len(raw) - 49)]
        gone = {k + j for k, w in enumerate(own) if w in seen for j in range(50)}
        seen.update(own)
        if left := bytes(c for k, c in enumerate(raw) if k not in gone).decode():
            out.append((i, left))
    yield out


def test_pipeline_against_plain_python(spark, sf):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    shared = " ".join(word() for _ in range(30))
    base = [" ".join(word() for _ in range(r.randrange(40, 90))) for _ in range(25)]
    texts = [*base, *base[:6], base[3].upper(), base[9] + " " + word(), *(f"{b} {shared} {' '.join(word() for _ in range(60))}" for b in (word(), word()))]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(4, base[4])] * 3 + [(7, " ".join(word() for _ in range(50)))] * 2 + [(100, None), (101, ""), (None, base[1])]
    r.shuffle(rows)
    names = "doc_id long, text string, lang string, source string, n_chars long, id long, rep int, _text string, kept boolean"
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", "s", len(t or ""), 1, 2, "x", False) for i, t in rows], names)
    now = corpus_pipeline.quality_rules(spark, docs, sf)
    assert sorted((x["doc_id"], x["text"]) for x in now.collect()) == sorted((i, t) for i, t in rows if i is not None and t)
    for want, (name, stage) in zip(brute_pipeline([(i, t) for i, t in rows if i is not None and t]), corpus_pipeline.STAGES[1:], strict=False):
        now = stored(stage(spark, now, sf), "test")
        assert now.columns == docs.columns
        assert sorted((x["doc_id"], x["text"]) for x in now.collect()) == sorted(want), name
        assert now.where("n_chars <> length(text)").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sorted((i, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 1])) for i, t in want)
    assert sum(p["length"] for p in pieces) == sum(len(x) for _, x in ids)
    assert sorted({(p["doc_id"], p["doc_tokens"]) for p in pieces}) == sorted({(i, len(x)) for i, x in ids})


def test_run_is_the_stages_one_after_the_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "test")
    key = lambda df: sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in df.collect())  # noqa: E731  cuts may differ, as rows come in another order
    join = lambda rows: [(d, b"".join(x for _, _, x in g)) for d, g in itertools.groupby(rows, lambda r: r[0])]
    assert join(key(corpus_pipeline.run(spark, sf))) == join(key(docs))


def test_a_stage_leaves_earlier_results_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, second = (corpus_pipeline.exact_duplicates(spark, docs, sf) for _ in range(2))
    sweep(spark)
    assert first.count() == second.count()


def test_folders_go_with_the_last_plan_that_reads_them(spark):
    df = stored(spark.range(9), "test")
    path = next(p for p in common._made if "/test-" in p and common._made[p].get() is not None and p in df.inputFiles()[0])
    plan = df.where("id > 3").groupBy("id").count()
    del df
    sweep(spark)
    assert path in common._made and plan.count() == 5
    del plan
    for _ in range(20):
        sweep(spark)
        if path not in common._made:
            return
        time.sleep(0.2)
    raise AssertionError("still there")


def test_pipeline_judges_rows_that_share_an_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = docs.limit(5).selectExpr(*["'too short' AS text" if c == "text" else c for c in docs.columns])
    judged = corpus_pipeline.quality_rules(spark, docs.unionByName(docs).unionByName(short), sf)
    assert judged.where("text = 'too short'").count() == 0
    once = corpus_pipeline.exact_duplicates(spark, docs.unionByName(docs), sf)
    assert once.count() == once.selectExpr("lower(text) AS t").distinct().count() == once.select("doc_id").distinct().count()


def test_pipeline_on_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
