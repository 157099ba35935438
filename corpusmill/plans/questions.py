"""Queries over questions, answers and model responses made from the documents, and their SQL.

The tables hold no such rows, so both engines make them alike: a document's id picks a form, and its
word (letters from its id's md5, g to v alone), language, source and length go into it.  What a form
must yield is what its rule says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boundary
from ..functions import chat as C
from ..functions import mcq as M
from ..functions import rewards as R
from ..functions import text as X
from ..operators import filters, sampling, sets, validation, windows
from ..sources.io import pinned

DEPARTMENTS = ["内科", "外科", "儿科"]
_HEX, _SAFE = "0123456789abcdef", "ghijklmnopqrstuv"
_W = f"translate(substr(md5(doc_id::VARCHAR), 1, 6), '{_HEX}', '{_SAFE}')"


def base(s, d) -> DataFrame:
    """doc_id, lang, source, n_chars; w: the word; one: an option's letter, two: the next one's."""
    x = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    w = F.translate(F.substr(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(1), F.lit(6)), _HEX, _SAFE)
    letter = lambda k: F.char(F.lit(65) + (F.col("doc_id") + k) % 5)
    return x.select("*", w.alias("w"), letter(0).alias("one"), letter(1).alias("two"))


_BASE = f"WITH x AS (SELECT doc_id, lang, source, n_chars, {_W} AS w, chr((65 + doc_id % 5)::INT) AS one, chr((65 + (doc_id + 1) % 5)::INT) AS two FROM documents)"


def _fill(form: str) -> Column:
    """A form whose {names} are columns."""
    parts = [p for x in form.split("{") for p in x.split("}")]
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])


def _pick(forms: list[str]) -> Column:
    """The form that the id picks, filled."""
    k = F.col("doc_id") % len(forms)
    return F.coalesce(*[F.when(k == i, _fill(f)) for i, f in enumerate(forms)])


def _sql(form: str | None) -> str:
    if form is None:
        return "NULL"
    parts = [p for x in form.split("{") for p in x.split("}")]
    return "(" + " || ".join("'" + p.replace("'", "''") + "'" if i % 2 == 0 else f"{p}::VARCHAR" for i, p in enumerate(parts)) + ")"


def _case(forms: list, show=_sql) -> str:
    return f"CASE doc_id % {len(forms)} " + " ".join(f"WHEN {i} THEN {show(f)}" for i, f in enumerate(forms)) + " END"


OPTIONS = "A. 胃酸分泌减少{w}\nB. 慢性失血{w}\nC. 脾脏肿大\nD. 妊娠\nE. 溶血"
_GOOD = "慢性失血{w}使铁丢失增多，是小细胞低色素性贫血最常见的原因。"
_WHY = "贫血{w}最常见的原因是"
MCQ_FORMS = [
    # question, options, answer, explanation, reason (None: passes)
    ("小细胞低色素性" + _WHY, OPTIONS, "B", _GOOD, None), (_WHY, OPTIONS, " b ", _GOOD, None), ("", OPTIONS, "B", _GOOD, "missing_or_incomplete_fields"),
    (_WHY, "A. 一{w}\nB. 二\nC. 三\nD. 四", "B", _GOOD, "invalid_options_format"), (_WHY, "A. 一{w}\nA. 二\nC. 三\nD. 四\nE. 五", "B", _GOOD, "invalid_options_format"),
    (_WHY, OPTIONS, "F", _GOOD, "answer_not_in_options"), ("关于贫血{w}，错误的是", OPTIONS, "B", _GOOD, "negative_question"), ("下列除{w}以外均可", OPTIONS, "B", _GOOD, "negative_question"),
    (_WHY, OPTIONS.replace("溶血", "以上均是"), "B", _GOOD, "combination_options"), ("如图所示，" + _WHY, OPTIONS, "B", _GOOD, "visual_or_table_dependency"), ("贫血<br>" + _WHY, OPTIONS, "B", _GOOD, "garbled_or_html"),
    (_WHY + "，", OPTIONS, "B", _GOOD, "question_truncated"), (_WHY, OPTIONS, "B", "慢性失血。", "explanation_missing_or_empty"),
    (_WHY, OPTIONS, "B", "慢性失血{w}（C对），是小细胞低色素性贫血最常见的原因。", "explanation_answer_conflict"), (_WHY, OPTIONS, "B", "血红蛋白合成{w}减少是这类贫血的主要机制之一。", "answer_absent_from_explanation"),
    (_WHY, OPTIONS, "B", "单纯慢性失血{w}时一般不会出现黄疸等溶血表现的情况", "knowledge_negative_statement"),
]


def _mcq(s, d) -> DataFrame:
    names = ("question", "options", "answer", "explanation")
    return base(s, d).select("doc_id", "w", *[_pick([f[i] for f in MCQ_FORMS]).alias(n) for i, n in enumerate(names)])


def mcq_screen(s, d):
    """F10-F15, X12, X14-X17"""
    return _mcq(s, d).select("doc_id", M.screen("question", "options", "answer", "explanation").alias("reason"))


CHOICES = [
    ("答案：{one}", "{one}"), ("故选 {one}", "{one}"), ("**{one}** {w}", "{one}"), ("选{one}或者{two}", None), ("{one}{two}", None), ("{one}/{two} {w}", None), ("{w}", None),
    ("{one}\n{two}", None), ("{one}。答案是{two}", None), ("{one}. {w}", "{one}"), ("选项{one}不正确", None), ("（{one}）。答案是{one}，因为{w}", "{one}"), ("正确答案为：【{one}】{w}", "{one}"), (" '{one}' ", "{one}"),
]


def mcq_choice(s, d):
    """X20"""
    raw = _pick([f for f, _ in CHOICES])
    return base(s, d).select("doc_id", M.extract_choice(raw, F.array(*map(F.lit, M.LETTERS))).alias("choice"))


LABEL_TEXTS = [("答案：儿科。{w}", "儿科"), ("内科或者外科 {w}", None), ("内科内科", None), ("内科", "内科"), ("建议 外科 就诊 {w}", "外科"), ("皮肤科{w}", None)]


def label_parse(s, d):
    """X22"""
    return base(s, d).select("doc_id", M.parse_label(_pick([f for f, _ in LABEL_TEXTS]), DEPARTMENTS).alias("label"))


OPTION_TEXTS = [("A. {w}\nB、{lang}\nA: {source}\nx", 2, "{source}"), ("{w}", 0, None), ("a. {w}\nC {lang}", 1, None), ("A：{w} {lang}", 1, "{w} {lang}")]


def options_lenient(s, d):
    """X11"""
    o = M.parse_options(_pick([f[0] for f in OPTION_TEXTS]))
    return base(s, d).select("doc_id", o.alias("o")).select("doc_id", F.size("o").alias("n"), F.try_element_at("o", F.lit("A")).alias("a"))


ANSWERS = [("正确答案：{w}（{one}）。", "{one}", "{w}"), ("正确答案: {w} {lang} ({one})。解析：因为{source}", "{one}", "{w} {lang}"), ("{one}", None, None)]


def answer_text_parse(s, d):
    """X21"""
    return base(s, d).select("doc_id", M.parse_answer_text(_pick([f[0] for f in ANSWERS])).alias("r")).select("doc_id", "r.*")


JUDGED = [("（{one}对），{w}（{two}错）、尿毒症。", "{one}", "{two}"), ("{one}对，{two}错误；{w}", "{one}", "{two}"), ("维生素{one}对{w}有益", "", "")]


def judged_letters(s, d):
    """X16"""
    x = base(s, d).select("doc_id", M.judged_letters(_pick([f[0] for f in JUDGED])).alias("j"))
    return x.select("doc_id", F.array_join("j.right", ",").alias("right"), F.array_join("j.wrong", ",").alias("wrong"))


def mcq_records(s, d) -> DataFrame:
    x = _mcq(s, d).where(M.screen("question", "options", "answer", "explanation").isNull())
    x = x.select(F.col("doc_id").alias("id"), X.strip("question").alias("question"), M.parse_options_strict("options").alias("options"), F.upper(X.strip("answer")).alias("answer"), X.strip("explanation").alias("explanation"))
    x = x.withColumn("answer_text", F.element_at("options", F.col("answer"))).withColumn("concise_knowledge", M.extract_knowledge("explanation", F.col("answer"), F.col("options"))["knowledge"])
    # the search for a knowledge sentence is costly, and its result is read several times
    return pinned(x.withColumn("target_text", M.compose_target(F.col("answer_text"), F.col("concise_knowledge"))))


def mcq_targets(s, d):
    """X18, X19, X32, B3"""
    t = lambda mode: M.build_target(mode, F.col("options"), F.col("answer"), F.col("explanation"))
    return mcq_records(s, d).select("id", "target_text", F.md5(M.format_prompt(F.col("question"), F.col("options"))).alias("prompt_md5"), t("letter").alias("letter"), t("answer_text").alias("full"), t("answer_rationale").alias("rationale"), t("concise_knowledge").alias("concise"))


#: What is wrong with records, by their id modulo 5.
_BROKEN = {
    1: ["options_incomplete"], 2: ["answer_text_differs", "target_not_by_template"], 3: ["target_not_by_template", "target_has_marker", "target_has_letter"],
    4: ["question_or_explanation_empty"],
}


def record_problems(s, d):
    """Records of which four in five are broken, each in its way."""
    way = F.col("id") % 5
    x = mcq_records(s, d).withColumns({
        "options": F.when(way == 1, F.map_filter("options", lambda k, v: k != "E")).otherwise(F.col("options")), "answer_text": F.when(way == 2, "x").otherwise(F.col("answer_text")),
        "target_text": F.concat("target_text", F.when(way == 3, "故选（B）").otherwise("")), "explanation": F.when(way != 4, F.col("explanation")).otherwise(""),
    })
    return validation.record_problems(x)


_TOOL = '<tool_call>{"name": "calculate_math", "arguments": {"expression": "'


def response_parse(s, d):
    """A whole answer; one whose thoughts were opened by the prompt; one whose call is no JSON."""
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    whole = F.concat(F.lit("<think>"), "lang", F.lit("</think> "), "w", F.lit(" " + _TOOL), n, F.lit('+2"}}</tool_call>'))
    half = F.concat("lang", F.lit("</think> "), "w", F.lit(" "), n)
    raw = F.when(k == 0, whole).when(k == 1, half).otherwise(F.concat("w", F.lit(" <tool_call>"), n, F.lit("{broken</tool_call>")))
    return base(s, d).select("doc_id", C.parse_response(raw).alias("r")).select("doc_id", "r.content", "r.reasoning", F.size("r.tool_calls").alias("n_calls"))


SUMS = ["{doc_id}+2*{n_chars}", "(2^{small})÷4", "math.sqrt({n_chars}*{n_chars})", "__import__('{w}')"]


def safe_arithmetic(s, d):
    """B5"""
    x = base(s, d).withColumn("small", F.col("doc_id") % 41)
    return x.select("doc_id", R.evaluate_arithmetic(_pick(SUMS)).alias("result"))


def verified_truths(s, d):
    """X25"""
    number = F.col("n_chars").cast("string")
    t = F.concat(F.lit("The total is "), F.format_number("n_chars", 0), F.lit(".50 yuan "), F.col("w"))
    return base(s, d).select("doc_id", F.size(R.verified_truths(t, F.array(F.concat(number, F.lit(".5")), F.upper("w"), number, F.lit("zzz")))).alias("n_verified"))


def agent_reward(s, d):
    """X26, X27"""
    n = (F.col("doc_id") + 2).cast("string")
    call = F.concat(F.lit(_TOOL), F.col("doc_id").cast("string"), F.lit('+2"}}</tool_call>'))
    unknown = F.lit('<tool_call>{"name": "unknown", "arguments": {}}</tool_call>')
    k = F.col("doc_id") % 3
    turns = F.when(k == 0, F.array(call, F.concat(F.lit("The answer is "), n, F.lit(".")))).when(k == 1, F.array(F.concat(F.lit("a plain answer without any tools "), F.col("w")))).otherwise(F.array(unknown, n))
    return base(s, d).select("doc_id", R.agent_reward(turns, F.array(n), F.array(F.lit("calculate_math")), k == 2).alias("reward"))


def supervision(s, d):
    """X33; a begins and b ends, and what stands between is kept."""
    a, b = (F.col("doc_id") % 50 + 10).cast("int"), (F.col("doc_id") % 7 + 60).cast("int")
    one, two = F.lit(1), F.lit(2)
    forms = [F.array(one, a, b, two, one, a, two, b), F.array(a, b), F.array(one, a, one, b), F.array(two, one, two, a)]
    ids = F.coalesce(*[F.when(F.col("doc_id") % 4 == i, f) for i, f in enumerate(forms)])
    return base(s, d).select("doc_id", F.array_join(C.supervision_mask(ids, [1], [2], 100).cast("array<string>"), ",").alias("labels"))


def closed_domain(s, d):
    """F17"""
    x = base(s, d).select("doc_id", F.concat(F.lit(" "), "lang", F.lit("\t")).alias("label"))
    return filters.closed_domain(x, "label", {"en": "English", "fr": "French"})


# ------------------------------------------------------------ filters and selection on the documents


def filter_flags(s, d):
    """F3, F5-F9, F16"""
    x = base(s, d).join(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("_id"), "text"), F.col("doc_id") == F.col("_id"))
    options = F.create_map(F.lit("A"), F.col("w"), F.lit("B"), F.substr("text", F.lit(1), (F.col("doc_id") % 120).cast("int")))
    letter = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.lower("one"))).otherwise(F.concat("one", "two"))
    return x.select(
        "doc_id", filters.within_budget(F.col("n_chars"), 512).alias("fits"), filters.long_enough("text", 300).alias("long_enough"), filters.valid_letter(letter).alias("letter"),
        filters.options_hold(options, F.col("one")).alias("options_hold"), filters.needs_image(F.concat("w", F.when(F.col("doc_id") % 5 == 0, "图").otherwise("文"))).alias("image"),
        filters.fits_evaluation("w", options).alias("evaluation"), filters.explained(F.substr("text", F.lit(1), (F.col("doc_id") % 20).cast("int"))).alias("explained"),
    )


def longest_target(s, d):
    """F4"""
    x = base(s, d)
    return filters.budget_with_longest(x, "n_chars", x.select(F.length("source").alias("n")), "n", 600).select("doc_id")


def reviewed(s, d):
    """F18, W11"""
    x = s.read.parquet(f"{d}/labels.parquet")
    reviews = x.select("doc_id", F.lit(1).alias("line"), F.when(F.col("quality") == 1, "no_obvious_issue").otherwise("issue").alias("verdict")).union(x.where("toxic = 1").select("doc_id", F.lit(2), F.lit("issue")))
    return filters.passed_review(base(s, d), "doc_id", windows.latest(reviews, "doc_id", ["line"])).select("doc_id")


def first_rows(s, d):
    """T9, T15"""
    return sampling.first_survivors(base(s, d).where("n_chars >= 600"), "doc_id", 25).select("doc_id")


def enough_rows(s, d):
    """T14"""
    return sampling.require_rows(base(s, d).where("lang = 'en'"), 10).select("doc_id")


def argmin_source(s, d):
    """The source of least mean length in each language."""
    m = base(s, d).groupBy("lang", "source").agg(F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("n"))
    m = m.withColumn("loss", F.col("total") / F.col("n"))
    return sampling.arg_best(m, "lang", "source", "loss", [f"src{i}" for i in range(40)], least=True)


def successive_draws(s, d):
    """Three draws, each from what the earlier ones left."""
    stages = [lambda x: sampling.sample(x, "doc_id", 15, 1), lambda x: x.where("doc_id % 3 = 0"), lambda x: x.where("n_chars < 500")]
    out = None
    for i, part in enumerate(sets.successive(base(s, d).select("doc_id", "n_chars"), "doc_id", stages)):
        part = part.select(F.lit(i).alias("stage"), "doc_id")
        out = part if out is None else out.union(part)
    return out


def digest_groups(s, d):
    """Classes of texts with equal 64-bit digests, told by their least id."""
    x = s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.digest("text").alias("k"))
    first = x.groupBy("k").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return x.join(first, "k").select("doc_id", "first", "n")


def rerun_check(s, d):
    """V6"""
    same = validation.reruns_equal(lambda: base(s, d).orderBy(F.rand()))
    other = validation.fingerprint(base(s, d)) == validation.fingerprint(base(s, d).withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") == 0).cast("long")))
    n, _ = validation.fingerprint(base(s, d))
    return s.createDataFrame([(n, same, other)], "n long, same boolean, other boolean")


def tokenised(s, d):
    """A tokenizer and a generator in their slots; over-long rows are refused."""
    x = boundary.with_tokens(base(s, d), "w", lambda: lambda texts: [[ord(c) for c in t] for t in texts], "ids")
    x = boundary.refuse_long(x, "ids", 6).select("doc_id", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"), "w")
    return boundary.generate(x, lambda: lambda b: b.assign(w=b["w"].str[::-1]), "doc_id long, n int, first int, w string").withColumnRenamed("w", "reversed")


QUERIES = {f.__name__: f for f in (
    mcq_screen, mcq_choice, label_parse, options_lenient, answer_text_parse, judged_letters, mcq_targets, record_problems, response_parse, safe_arithmetic,
    verified_truths, agent_reward, supervision, closed_domain, filter_flags, longest_target, reviewed, first_rows, enough_rows, argmin_source, successive_draws,
    digest_groups, rerun_check, tokenised,
)}

_CLEAR = "'[" + r"\s\p{Z}\x{85}\x{1c}-\x{1f}" + "]+'"
_PROMPT = "'请直接输出正确选项的字母（如 A、B、C、D、E），不要输出多余解释。'"
_RECORDS = _BASE + f""", r AS (SELECT doc_id AS id, w, CASE doc_id % 16 WHEN 0 THEN {_sql(MCQ_FORMS[0][0])} ELSE {_sql(_WHY)} END AS question, {_sql(_GOOD)} AS explanation, {_sql(OPTIONS)} AS options FROM x WHERE doc_id % 16 < 2)"""
ORACLES = {
    "mcq_screen": f"{_BASE} SELECT doc_id, {_case([f[4] for f in MCQ_FORMS])} AS reason FROM x",
    "mcq_choice": f"{_BASE} SELECT doc_id, {_case([c for _, c in CHOICES])} AS choice FROM x",
    "label_parse": f"{_BASE} SELECT doc_id, {_case([c for _, c in LABEL_TEXTS])} AS label FROM x",
    "options_lenient": f"{_BASE} SELECT doc_id, {_case([f[1] for f in OPTION_TEXTS], str)} AS n, {_case([f[2] for f in OPTION_TEXTS])} AS a FROM x",
    "answer_text_parse": f"{_BASE} SELECT doc_id, {_case([f[1] for f in ANSWERS])} AS letter, {_case([f[2] for f in ANSWERS])} AS answer_text FROM x",
    "judged_letters": f'{_BASE} SELECT doc_id, {_case([f[1] for f in JUDGED])} AS "right", {_case([f[2] for f in JUDGED])} AS wrong FROM x',
    "mcq_targets": _RECORDS + f""" SELECT id, '慢性失血' || w || '。知识点：' || rtrim(explanation, '。') || '。' AS target_text, md5(question || chr(10) || options || chr(10) || {_PROMPT}) AS prompt_md5,
        'B<|im_end|>' || chr(10) AS letter, '正确答案：慢性失血' || w || '（B）。<|im_end|>' || chr(10) AS "full", '正确答案：慢性失血' || w || '（B）。解析：' || explanation || '<|im_end|>' || chr(10) AS rationale,
        '慢性失血' || w || '。' || explanation || '<|im_end|>' || chr(10) AS concise FROM r""",
    "record_problems": _RECORDS + " SELECT id, problem FROM r JOIN (VALUES " + ", ".join(f"({k}, '{p}')" for k, ps in _BROKEN.items() for p in ps) + ") v(k, problem) ON id % 5 = k",
    "response_parse": f"""{_BASE} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN w WHEN 1 THEN w || ' ' || doc_id ELSE w || ' <tool_call>' || doc_id || '{{broken</tool_call>' END AS content,
        CASE WHEN doc_id % 3 < 2 THEN lang END AS reasoning, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_calls FROM x""",
    "safe_arithmetic": f"{_BASE} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (doc_id + 2 * n_chars)::VARCHAR WHEN 1 THEN (pow(2, doc_id % 41) / 4)::DOUBLE::VARCHAR WHEN 2 THEN n_chars::DOUBLE::VARCHAR END AS result FROM x",
    "verified_truths": f"{_BASE} SELECT doc_id, 2 + (contains(format('{{:,}}', n_chars), n_chars::VARCHAR))::INT AS n_verified FROM x",
    "agent_reward": f"{_BASE} SELECT doc_id, (CASE doc_id % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 0.5 ELSE -1.5 END)::DOUBLE AS reward FROM x",
    "supervision": "WITH x AS (SELECT doc_id, doc_id % 50 + 10 AS a, doc_id % 7 + 60 AS b FROM documents) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '-100,' || a || ',' || b || ',2,-100,' || a || ',2,-100' WHEN 1 THEN '-100,-100' WHEN 2 THEN '-100,' || a || ',1,' || b ELSE '-100,-100,2,-100' END AS labels FROM x",
    "closed_domain": "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' ELSE 'French' END AS label FROM documents WHERE lang IN ('en', 'fr')",
    "filter_flags": f"""
        {_BASE}, t AS (SELECT x.*, coalesce(text, '') AS text, regexp_replace(regexp_replace(substring(coalesce(text, ''), 1, (doc_id % 120)::INT), '^' || {_CLEAR}, ''), {_CLEAR} || '$', '') AS bs FROM x JOIN documents USING (doc_id))
        SELECT doc_id, n_chars <= 512 AS fits, length(regexp_replace(coalesce(text, ''), {_CLEAR}, '', 'g')) >= 300 AS long_enough, doc_id % 3 = 0 AS letter, one IN ('A', 'B') AS options_hold, doc_id % 5 = 0 AS image,
            length(bs) BETWEEN 1 AND 80 AS evaluation, length(regexp_replace(regexp_replace(substring(text, 1, (doc_id % 20)::INT), '^' || {_CLEAR}, ''), {_CLEAR} || '$', '')) >= 10 AS explained FROM t""",
    "longest_target": "SELECT doc_id FROM documents WHERE n_chars + (SELECT max(length(source)) FROM documents) <= 600",
    "reviewed": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0",
    "first_rows": "SELECT doc_id FROM documents WHERE n_chars >= 600 ORDER BY doc_id LIMIT 25",
    "enough_rows": "SELECT doc_id FROM documents WHERE lang = 'en'",
    "argmin_source": "WITH m AS (SELECT lang, source, sum(n_chars) / count(*) AS loss FROM documents GROUP BY 1, 2) SELECT lang, arg_min(source, loss) AS best FROM m GROUP BY 1",
    "successive_draws": """
        WITH a AS (SELECT doc_id FROM documents ORDER BY md5(concat('1:', doc_id::VARCHAR)), doc_id LIMIT 15),
        b AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM a))
        SELECT 0 AS stage, doc_id FROM a UNION ALL SELECT 1, doc_id FROM b UNION ALL SELECT 2, doc_id FROM documents WHERE n_chars < 500 AND doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM a)""",
    "digest_groups": "SELECT doc_id, min(doc_id) OVER w AS first, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))",
    "rerun_check": "SELECT count(*) AS n, true AS same, false AS other FROM documents",
    "tokenised": f"{_BASE} SELECT doc_id, 6 AS n, ascii(w) AS first, reverse(w) AS reversed FROM x",
}
