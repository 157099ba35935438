"""Training rows against plain Python that finds answers by the ids of their markers."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.operators import training, vocabulary
from corpusmill.plans import registry

THINK = "<think>\n\n</think>\n\n"


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens(["<|im_start|>", "<|im_end|>"])
    return t


@pytest.fixture(scope="module")
def conversations(sf):
    rows = pq.read_table(f"{sf}/conversations.parquet").to_pylist()
    out = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        out.setdefault(r["conv_id"], []).append(r)
    return out


def ids_of(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


def plain_mask(tok, ids, length):
    begin, end = ids_of(tok, "<|im_start|>assistant\n"), ids_of(tok, "<|im_end|>\n")
    mask, i = [0] * len(ids), 0
    while i < len(ids):
        if ids[i : i + len(begin)] != begin:
            i += 1
            continue
        i = j = i + len(begin)
        while j < len(ids) and ids[j : j + len(end)] != end:
            j += 1
        for k in range(i, min(j + len(end), len(ids), length)):
            mask[k] = 1
        i = j + len(end)
    return mask


def fixed(xs, length, filler):
    return (xs[:length] + [filler] * length)[:length]


def draw(key, seed):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) / 2**32


def render(turns):
    return "".join(f"<|im_start|>{r}\n" + (THINK + t.lstrip("\n") if r == "assistant" else t) + "<|im_end|>\n" for r, t in turns)


def thinned(text, key, seed=0):
    return text.replace(THINK, "") if draw(key, seed) > 0.2 else text


def by_key(spark, sf, name, *keys):
    rows = registry.queries()[name](spark, sf).collect()
    out = {tuple(r[k] for k in keys): r for r in rows}
    assert len(out) == len(rows)
    return out


def test_pretraining_rows(spark, sf, tok, conversations):
    got = by_key(spark, sf, "pretraining_rows", "conv_id", "turn")
    assert len(got) == sum(map(len, conversations.values()))
    for turns in conversations.values():
        for t in turns:
            want = fixed([50257, *ids_of(tok, t["text"] or "")[:254], 50258], 256, 50256)
            r = got[t["conv_id"], t["turn"]]
            assert r["input_ids"] == want and r["labels"] == [-100 if x == 50256 else x for x in want]


def test_finetuning_rows(spark, sf, tok, conversations):
    got = by_key(spark, sf, "finetuning_rows", "conv_id")
    assert len(got) == len(conversations)
    added = supervised = 0
    for key, turns in conversations.items():
        said = [(t["role"], t["text"]) for t in turns]
        if said[0][0] != "system" and draw(key, 0) < 0.2:
            said = [("system", ["You are a helpful AI assistant.", "Answer briefly."][int(draw(key, 1) * 2)]), *said]
            added += 1
        ids = ids_of(tok, thinned(render(said), key))
        mask = plain_mask(tok, ids, 512)
        ids, mask = fixed(ids, 512, 50256), fixed(mask, 512, 0)
        r = got[(key,)]
        assert r["input_ids"] == ids and r["labels"] == [i if m else -100 for i, m in zip(ids, mask, strict=True)]
        supervised += sum(mask)
    assert added and supervised


def test_finetuning_rows_with_tools_and_calls(spark, sf, tok, conversations):
    got = by_key(spark, sf, "finetuning_tool_rows", "conv_id")
    tools = [{"name": "lookup", "parameters": {"n": "int"}}]
    head = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n" + json.dumps(tools[0])
    head += '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
    for key, turns in conversations.items():
        roles = ["tool" if t["turn"] % 5 == 4 else t["role"] for t in turns]
        text = ""
        if key % 2 == 0:
            text = "<|im_start|>system\n" + (turns[0]["text"] + "\n\n" if roles[0] == "system" else "") + head + "<|im_end|>\n"
        for i, (t, role) in enumerate(zip(turns, roles, strict=True)):
            if role == "assistant":
                call = f'<tool_call>\n{{"name": "lookup", "arguments": {{"n": {t["turn"]}}}}}\n</tool_call>' if t["turn"] % 3 == 1 else ""
                said = t["text"].lstrip("\n") + ("\n" if call and t["text"] else "") + call
                text += f"<|im_start|>assistant\n<think>\n{'so' if t['turn'] % 2 else ''}\n</think>\n\n{said}<|im_end|>\n"
            elif role == "tool":
                text += "<|im_start|>user" * (i == 0 or roles[i - 1] != "tool") + f"\n<tool_response>\n{t['text']}\n</tool_response>" + "<|im_end|>\n" * (i + 1 == len(roles) or roles[i + 1] != "tool")
            elif not (i == 0 and role == "system" and key % 2 == 0):
                text += f"<|im_start|>{role}\n{t['text']}<|im_end|>\n"
        ids = ids_of(tok, thinned(text, key))
        mask = plain_mask(tok, ids, 512)
        ids, mask = fixed(ids, 512, 50256), fixed(mask, 512, 0)
        assert got[(key,)]["input_ids"] == ids and got[(key,)]["labels"] == [i if m else -100 for i, m in zip(ids, mask, strict=True)]


def test_preference_rows(spark, sf, tok, conversations):
    got = by_key(spark, sf, "preference_rows", "conv_id")
    for key, turns in conversations.items():
        good = [(t["role"], t["text"]) for t in turns]
        bad = [*good[:-1], (good[-1][0], good[-2][1] if len(good) > 1 else good[-1][1])]
        for k, (name, said) in enumerate((("chosen", good), ("rejected", bad))):
            ids = ids_of(tok, thinned(render(said), key, k))
            mask = fixed(plain_mask(tok, ids, 384), 384, 0)
            ids = fixed(ids, 384, 50256)
            assert got[(key,)][f"x_{name}"] == ids[:-1] and got[(key,)][f"y_{name}"] == ids[1:] and got[(key,)][f"mask_{name}"] == mask[1:]


def test_rows_of_odd_texts(spark, tok):
    tokens = training.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "日本語 ☕", "a <|endoftext|> b", "x " * 900]
    got = training.pretraining_rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", tokens, 16).orderBy("i").collect()
    for t, r in zip(texts, got, strict=True):
        want = fixed([50257, *ids_of(tok, t or "")[:14], 50258], 16, 50256)
        assert r["input_ids"] == want and r["labels"] == [-100 if x == 50256 else x for x in want]
    odd = ["<|im_start|>assistant\nno end", "<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n", "<|im_start|>user\n<|im_start|>assistant\nq<|im_end|>\nz", "", "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", training.chat_rows(F.col("t"), tokens, 12).alias("r")).orderBy("i").collect()
    for t, r in zip(odd, rows, strict=True):
        ids = ids_of(tok, t)
        assert r["r"]["input_ids"] == fixed(ids, 12, 50256) and r["r"]["mask"] == fixed(plain_mask(tok, ids, 12), 12, 0)
    with pytest.raises(ValueError):
        training.pretraining_rows(spark.range(1).selectExpr("'x' AS text"), "text", tokens, 1)


def plain_merge(symbols, left, right):
    out = []
    for x in symbols:
        if out and out[-1] == left and x == right:
            out[-1] = left + right
        else:
            out.append(x)
    return out


def test_merge_counts(spark, sf):
    """Against a count of every pair in every word anew before each merge."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    words = Counter(w for x in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).to_pydict()["text"] if x for w, _ in t.pre_tokenizer.pre_tokenize_str(x))
    symbols, want = {w: list(w) for w in words}, {}
    for rank, (left, right) in enumerate(vocabulary.merges_of(path)[:200]):
        pairs = sum(n * sum(a == left and b == right for a, b in zip(symbols[w], symbols[w][1:], strict=False)) for w, n in words.items())
        before = sum(n * len(symbols[w]) for w, n in words.items())
        symbols = {w: plain_merge(x, left, right) for w, x in symbols.items()}
        if pairs:
            want[rank] = (left, right, pairs, before - sum(n * len(symbols[w]) for w, n in words.items()))
    got = {r["rank"]: (r["left"], r["right"], r["n_pairs"], r["n_merged"]) for r in registry.queries()["merge_counts"](spark, sf).collect()}
    assert got == want and len(got) > 50


def test_piece_counts(spark, sf, tok):
    want = Counter(p for x in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).to_pydict()["text"] if x for p in tok.encode(x, add_special_tokens=False).tokens)
    assert {r["piece"]: r["n"] for r in registry.queries()["piece_counts"](spark, sf).collect()} == want


def test_overlapping_pairs_and_empty_texts(spark):
    own = vocabulary.Words(iter([("aaaa", 2), ("aab", 3), ("x", 1)]))
    assert own.merge("a", "a") == (9, 7) and own.symbols == [["aa", "aa"], ["aa", "b"], ["x"]]
    assert own.merge("aa", "b") == (3, 3) and own.merge("a", "a") == (0, 0)
    path = public_tokenizers.path("byte_bpe_50k.json")
    none = spark.createDataFrame([(None,), ("",)], "text string")
    words = vocabulary.word_counts(none, "text", path)
    assert words.count() == 0 and vocabulary.merge_counts(words, path).count() == 0 and vocabulary.piece_counts(words, path).count() == 0
