"""Predicates, joins and template pieces on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import chat, mcq, rewards
from corpusmill.functions import text as X
from corpusmill.operators import aggregates, filters, joins, sets, validation, windows


def flags(spark, rows, schema, c):
    return [r["r"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").withColumn("r", c).orderBy("i").collect()]


def test_text_predicates(spark):
    assert flags(spark, [("a" * 30,), ("ab" * 30,), ("short",), (None,)], "t string", filters.hard_quality("t")) == [True, False, False, False]
    assert flags(spark, [("a b c d e f g h",), ("a b",), (None,)], "t string", filters.long_enough("t", 8)) == [True, False, False]
    assert flags(spark, [(" b ",), ("F",), ("AB",), (None,)], "t string", filters.valid_letter("t")) == [True, False, False, False]
    assert flags(spark, [("如图",), ("文字",), (None,)], "t string", filters.needs_image("t")) == [True, False, False]
    assert flags(spark, [("x" * 10,), (" x ",), (None,)], "t string", filters.explained("t")) == [True, False, False]
    assert flags(spark, [(5,), (6,)], "n int", filters.within_budget(F.col("n"), 5)) == [True, False]


def test_option_predicates(spark):
    rows = [({"A": "x", "B": "y"}, "b"), ({"A": "x", "B": "y"}, "C"), ({"A": "x"}, "A"), (None, "A")]
    assert flags(spark, rows, "o map<string,string>, a string", filters.options_hold(F.col("o"), F.col("a"))) == [True, False, False, False]
    rows = [("q", {"A": "x"}), ("q" * 101, {"A": "x"}), ("q", {"A": " "}), ("q", {"A": "x" * 81})]
    assert flags(spark, rows, "q string, o map<string,string>", filters.fits_evaluation("q", F.col("o"))) == [True, False, False, False]
    assert flags(spark, [({"A": "1", "B": "2"},), ({"B": "2"},), (None,)], "o map<string,string>", sets.same_keys(F.col("o"), ["B", "A"])) == [True, False, False]


def test_question_rules(spark):
    rows = [("以上都对",), ("A 和 B",), ("AB型血",), ("A、C",)]
    assert flags(spark, rows, "t string", mcq.is_combination(F.col("t"))) == [True, True, False, True]
    rows = [("（A错）",), ("维生素A对视觉有益",), ("B正确",), ("，C错误。",)]
    assert flags(spark, rows, "t string", mcq.has_marker(F.col("t"))) == [True, False, True, True]
    rows = [("下列哪项不包括", ""), ("除铁外", ""), ("原因是", "错，为本题正确答案"), ("原因是", "对")]
    assert flags(spark, rows, "q string, e string", mcq.is_negative(F.col("q"), F.col("e"))) == [True, True, True, False]
    rows = [("（B对）铁", "B"), ("（A对）铁", "B"), ("（B错）铁", "B"), ("答案为C", "B"), ("答案为B", "B")]
    assert flags(spark, rows, "e string, a string", mcq.is_conflicted(F.col("e"), F.col("a"))) == [False, True, True, True, False]


def test_concise_knowledge(spark):
    rows = [("甲很常见。乙是原因（B对）。", "乙"), ("整体如此，这是长句子的内容。", "这是长句子的内容。别的内容在这里"), ("没有。", "乙")]
    assert flags(spark, rows, "e string, a string", mcq.concise_knowledge("e", F.col("a"))) == ["乙是原因。", "整体如此，这是长句子的内容。", None]


def test_reviews_and_exclusions(spark):
    d = spark.createDataFrame([("a",), ("b",), ("c",)], "q_md5 string")
    reviews = spark.createDataFrame([("a", "bad", 1), ("a", "no_obvious_issue", 2), ("b", "no_obvious_issue", 1), ("b", "bad", 2)], "q_md5 string, verdict string, line int")
    assert [r["q_md5"] for r in filters.passed_review(d, "q_md5", windows.latest(reviews, "q_md5", ["line"])).collect()] == ["a"]
    entries = spark.createDataFrame([("a", "exclude", "all"), ("b", "exclude", "train"), ("c", "keep", "all"), ("c", "exclude", None)], "q_md5 string, decision string, exclude_from string")
    assert {r["q_md5"] for r in joins.exclusions(entries, "all").collect()} == {"a", "c"}
    assert {r["q_md5"] for r in joins.exclude(d, "q_md5", joins.exclusions(entries, "train")).collect()} == {"a", "c"}
    raw = spark.createDataFrame([(1, "t")], "row_id int, text string")
    assert joins.back_reference(spark.createDataFrame([(1,), (2,)], "source_row int"), raw, ["text"]).where("raw_text IS NULL").count() == 1


def test_closed_domain_can_be_strict(spark):
    d = spark.createDataFrame([("x",)], "label string")
    with pytest.raises(Exception, match="outside its domain"):
        filters.closed_domain(d, "label", {"a": "a"}, strict=True).collect()


def test_empty_inputs_have_defined_metrics(spark):
    none = spark.createDataFrame([], "truth string, p string, ok boolean, loss double, n long, t string")
    m = aggregates.confusion(none, "truth", "p", ["a", "b"])
    assert m.count() == 6 and m.agg(F.sum("n")).first()[0] == 0
    assert aggregates.macro_f1(m).first()[0] == 0.0
    assert aggregates.weighted_mean(none, "loss", "n").first()[0] == 0.0
    assert aggregates.rates(none, ["ok"]).first().asDict() == {"n": 0, "ok_rate": 0.0}
    assert aggregates.length_stats(none, F.col("t")).first().asDict() == {"min_length": 0, "max_length": 0, "mean_length": 0.0}
    assert aggregates.collapse(none, "p").count() == 0
    assert aggregates.mcnemar(none.withColumn("x", F.col("ok")), "ok", "x").first()["p"] == 1.0


def test_collapse_levels(spark):
    make = lambda n, k: spark.createDataFrame([("a",)] * n + [("b",)] * k, "p string")
    assert [aggregates.collapse(make(*x), "p").first()["collapse"] for x in ((40, 0), (38, 2), (20, 20))] == ["total", "near", "none"]


def test_balance_and_acceptance(spark):
    d = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "a")], "s string, l string")
    assert {r["s"]: (r["balanced"], r["whole"]) for r in validation.balanced(d, "l", "s", 2).collect()} == {"x": (True, True), "y": (False, True)}
    a = validation.acceptance(d, {"rows": F.count(F.lit(1)) == 4, "none": F.count_if(F.col("l") == "a") == 0}, {"none": F.count_if(F.col("l") == "a")})
    assert {r["check"]: (r["ok"], r["detail"]) for r in a.collect()} == {"rows": (True, ""), "none": (False, "3")}


def test_padding_and_losses(spark):
    d = spark.createDataFrame([([1, 2, 3],), ([],)], "x array<int>")
    assert [r[0] for r in d.select(chat.pad(F.col("x"), 2, 9)).collect()] == [[1, 2], [9, 9]]
    assert d.select(chat.shifted(F.col("x")).alias("s")).first()["s"].asDict() == {"x": [1, 2], "y": [2, 3]}
    loss = spark.range(1).select(rewards.preference_loss(F.lit(-1.0), F.lit(-2.0), F.lit(-1.0), F.lit(-2.0))).first()[0]
    assert loss == pytest.approx(0.6931471805599453)
    big = spark.range(1).select(rewards.preference_loss(F.lit(-1e5), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0)).first()[0]
    assert big == pytest.approx(1e5)


def test_form_score_bounds(spark):
    d = spark.createDataFrame([("问题是什么呢请回答", "第一段。\n第二段。", 200), ("", None, 0)], "q string, a string, n int")
    scores = [r[0] for r in d.select(X.form_score("q", "a", F.col("n"))).collect()]
    assert 0.7 < scores[0] <= 1.0 and scores[1] == pytest.approx(0.3 * 0.4 + 0.1 * 0.8)


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("高血压（A对，为本题正确答案）常见于老年人。", "高血压常见于老年人"),
        ("（E对BCD错）该药可降压（见说明）", "该药可降压（见说明）"),
        ("外（里（A错）层）留下（（B对））", "外（里层）留下（）"),
        ("（正确）应用广泛", "应用广泛"),
        ("开口（A对没有合上", "开口（A对没有合上"),
        ("A对，该药有效，B错；故本题答案为C", "该药有效"),
        ("本题考查的是因此该药有效", "该药有效"),
        ("为本题正确选项", ""),
        (None, ""),
    ],
)
def test_cleaned_fragments(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(mcq.clean_fragment("t")).first()[0] == clean


def test_judged_letters_in_brackets_and_alone(spark):
    rows = [("（A对，B错，见上），C正确；( D 错误)；E错误", [["A", "C"], ["B", "D", "E"]]), ("A型 对（X错）B错了，", [[], []]), ("", [[], []])]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(mcq.judged_letters("t").alias("j")).collect()
    assert [[r["j"]["right"], r["j"]["wrong"]] for r in got] == [w for _, w in rows]
