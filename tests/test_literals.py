"""Question, answer and response parsers on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import chat, mcq, rewards
from corpusmill.operators import aggregates, dedup, windows

def each(spark, rows, make):
    """make of a column, over rows."""
    d = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r["r"] for r in d.select("i", make(F.col("x")).alias("r")).orderBy("i").collect()]


CHOICES = {
    "A": "A", " B ": "B", "C.": "C", "D、": "D", "(A)": "A", "[B]": "B", "【C】": "C", "**D**": "D", "E\n": "E", "a": "A", "b.": "B", "答案：B": "B", "答案: B": "B", "答案是 C": "C", "答案为 A": "A",
    "正确答案是 D": "D", "选A": "A", "选择 B": "B", "故选 C": "C", "所以选 D": "D", "本题选 E": "E", "应当选 A": "A", "A. 遗传因素": "A", "B: 微生物": "B", "C 饮食习惯": "C", "我选A": "A", "'B'": "B",
    "A. 答案是A": "A", "选A或者B": None, "AB": None, "A/B": None, "答案可能是A也可能是C": None, "F": None, "选F": None, "龋齿是一种常见的口腔感染性疾病": None, "": None, "   ": None, "After careful review": None,
    "A\nB": None, "A。答案是B": None, "选项A不正确": None, "A和B": None, "（A）、（B）": None,
}


def test_choices(spark):
    got = each(spark, list(CHOICES), lambda c: mcq.extract_choice(c, F.array(*map(F.lit, mcq.LETTERS))))
    assert dict(zip(CHOICES, got, strict=True)) == CHOICES
    assert each(spark, ["C", "b", None], lambda c: mcq.extract_choice(c, F.array(F.lit("A"), F.lit("b")))) == [None, "B", None]


def test_labels_options_and_answers(spark):
    labels = {"答案：儿科。": "儿科", "内科或者外科": None, "内科内科": None, "内科": "内科", "建议 外科 就诊": "外科", "皮肤科": None}
    assert each(spark, list(labels), lambda c: mcq.parse_label(c, ["内科", "外科", "儿科"])) == list(labels.values())
    assert each(spark, ["A. 一\nB、二\nA: 三\nx", "", "a. 小写\nC 丙"], mcq.parse_options) == [{"A": "三", "B": "二"}, {}, {"C": "丙"}]
    got = each(spark, ["正确答案：铁缺乏（B）。", "正确答案: 铁缺乏 (B)。解析：因为缺铁", "B"], mcq.parse_answer_text)
    assert [(r["letter"], r["answer_text"]) for r in got] == [("B", "铁缺乏"), ("B", "铁缺乏"), (None, None)]
    judged = each(spark, ["（B对），高血压危象（A错）、尿毒症（C错）。", "A对，B错", "维生素A对视觉有益"], mcq.judged_letters)
    assert [(r["right"], r["wrong"]) for r in judged] == [(["B"], ["A", "C"]), (["A"], ["B"]), ([], [])]


def test_responses_and_arithmetic(spark):
    call = '<tool_call>{"name": "calculate_math", "arguments": {"expression": "1+2"}}</tool_call>'
    got = each(spark, [f"<think>a</think> b {call}", "thoughts</think> answer", "plain <tool_call>{broken</tool_call>"], chat.parse_response)
    assert [(r["content"], r["reasoning"], len(r["tool_calls"])) for r in got] == [("b", "a", 1), ("answer", "thoughts", 0), ("plain <tool_call>{broken</tool_call>", None, 0)]
    assert each(spark, ["1+2*3", "(2^10)÷4", "math.sqrt(16)", "__import__('os')", None], rewards.evaluate_arithmetic) == ["7", "256.0", "4.0", None, None]
    with pytest.raises(ValueError, match="too large"):
        rewards.arithmetic("((10**1000)**1000)")


def test_supervision_mask(spark):
    cases = [
        ([1, 5, 6, 2, 1, 7, 2, 9], [1], [2], [-100, 5, 6, 2, -100, 7, 2, -100]), ([3, 4], [1], [2], [-100, -100]), ([1, 8], [1], [2], [-100, 8]), ([], [1], [2], []), (None, [1], [2], []),
        ([1, 1, 5, 2, 2, 1, 1, 1, 2, 2], [1, 1], [2, 2], [-100, -100, 5, 2, 2, -100, -100, 1, 2, 2]), ([1, 2, 2], [1], [2], [-100, 2, -100]), ([1, 1, 2], [1], [2], [-100, 1, 2]),
    ]
    for ids, begin, end, want in cases:
        d = spark.createDataFrame([(ids,)], "ids array<int>")
        assert d.select(chat.supervision_mask(F.col("ids"), begin, end, 100)).first()[0] == want
    assert spark.createDataFrame([([1, 5, 6, 2],)], "ids array<int>").select(chat.supervision_mask(F.col("ids"), [1], [2], 2)).first()[0] == [-100, 5, -100, -100]


def test_ties_leave_one_row(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), (None, 5, "y"), (None, 5, "y"), ("", 1, "z"), ("", 1, "z")], "k string, o int, l string")
    assert sorted(("-" if r["k"] is None else r["k"], r["o"]) for r in dedup.keep_first(d, "k", "o").collect()) == [("", 1), ("-", 5), ("a", 1)]
    assert [(r["k"], r["o"]) for r in dedup.merge_groups(d, "k", "l", "o").collect()] == [("a", 1)]
    latest = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], "k string, o int, l string")
    assert windows.latest(latest, "k", ["o"]).first()["l"] == "y"


def test_equal_rows_take_part_in_a_similarity_join_once(spark):
    grams = [[f"g{i}" for i in range(20)], [f"g{i}" for i in range(19)], ["x"], []]
    rows = [(i, grams[0]) for i in range(3000)] + [(3000 + i, grams[1][::-1]) for i in range(3000)] + [(9000, grams[2]), (9001, grams[3])]
    d = spark.createDataFrame(rows, "row int, g array<string>")
    pairs, members = dedup.similar_classes(d, "row", "g", 0.9)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(0, 3000)]
    assert {(r["rep"], r["count"]) for r in members.groupBy("rep").count().collect()} == {(0, 3000), (3000, 3000), (9000, 1)}
    assert sorted(r["row"] for r in dedup.drop_near_duplicates(d, "row", "g", 0.9).collect()) == [0, 9000]
    assert sorted(r["row"] for r in dedup.drop_similar_to(d, "row", "g", d.where("row = 3000"), 0.99).collect()) == [*range(3000), 9000, 9001]


def test_a_long_chain_of_similar_rows(spark):
    rows = spark.range(20).selectExpr("id AS row")
    chain = spark.range(19).selectExpr("id AS a", "id + 1 AS b")
    assert sorted(r["row"] for r in dedup.greedy_drop(rows, "row", chain).collect()) == list(range(0, 20, 2))


def test_binomial_tail():
    assert aggregates.binomial_p(500, 501) == pytest.approx(aggregates.binomial_p(500, 500), rel=0.06)
    assert aggregates.binomial_p(5_000_000, 5_000_000) == 1.0
    assert aggregates.binomial_p(4_990_000, 5_010_000) == pytest.approx(2.54e-10, rel=0.02)


def test_classes_must_be_equal(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "l string, i int")
    with pytest.raises(ValueError, match="not equal"):
        windows.round_robin(d, "l", ["i"], ["a", "b"])
    with pytest.raises(ValueError, match="not equal"):
        windows.round_robin(d.where("i = 1"), "l", ["i"], ["a", "c"])


def test_running_best_over_partitions(spark):
    import random

    r = random.Random(3)
    rows = [(run, i, r.random()) for run in "ab" for i in range(200)]
    want = {(run, i): all(loss < x for q, j, x in rows if q == run and j < i) for run, i, loss in rows}
    got = windows.running_best(spark.createDataFrame(rows, "run string, i int, loss double"), "i", "loss", "run").collect()
    assert {(x["run"], x["i"]): x["is_best"] for x in got} == want
