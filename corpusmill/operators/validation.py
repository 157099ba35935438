"""Validation: problems of records, leakage between splits, acceptance checks, reruns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mcq import FORBIDDEN_TARGET, LETTERS, PAREN_LETTER, compose_target, has_marker
from ..functions.text import strip, text
from .sets import same_keys


def record_problems(df: DataFrame) -> DataFrame:
    """V1: (id, problem), one row per problem of a curated question; the first two hide the others."""
    o, a, target = F.col("options"), F.coalesce("answer", F.lit("")), text("target_text")
    answer = F.try_element_at(o, a)
    first = F.when(~same_keys(o, LETTERS), "options_incomplete").when(~a.isin(*LETTERS) | answer.isNull(), "answer_not_in_options")
    rest = F.array(
        F.when(~F.col("answer_text").eqNullSafe(answer), "answer_text_differs"),
        F.when(strip("concise_knowledge") == "", "knowledge_empty"),
        F.when(target != compose_target(text("answer_text"), text("concise_knowledge")), "target_not_by_template"),
        F.when(has_marker(target) | target.rlike(FORBIDDEN_TARGET), "target_has_marker"),
        F.when(target.rlike(PAREN_LETTER), "target_has_letter"),
        F.when((text("question") == "") | (text("explanation") == ""), "question_or_explanation_empty"),
    )
    problems = F.when(first.isNotNull(), F.array(first)).otherwise(F.filter(rest, lambda x: x.isNotNull()))
    return df.select("id", F.explode(problems).alias("problem"))


def leakage(splits: dict[str, DataFrame], key: str) -> DataFrame:
    """V2: (a, b, key) of keys that two splits share."""
    names, out = list(splits), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d = splits[a].select(key).intersect(splits[b].select(key)).select(F.lit(a).alias("a"), F.lit(b).alias("b"), key)
            out = d if out is None else out.union(d)
    if out is None:
        raise ValueError("two splits are needed")
    return out


def broken_references(df: DataFrame, raw: DataFrame, columns: list[str], row: str = "source_row") -> DataFrame:
    """V2: rows whose text is not that of the raw row they name."""
    r = raw.select(F.col("row_id").alias(row), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    same: Column = F.col("_there").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(r, row, "left").where(~same).drop("_there", *[f"_{c}" for c in columns])


def acceptance(df: DataFrame, checks: dict[str, Column], details: dict[str, Column] | None = None) -> DataFrame:
    """V3: (check, ok, detail) from aggregates over df, all in one pass."""
    details = details or {}
    one = df.agg(*[c.alias(f"ok_{i}") for i, c in enumerate(checks.values())], *[F.coalesce(details.get(k, F.lit("")).cast("string"), F.lit("")).alias(f"d_{i}") for i, k in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(F.col(f"ok_{i}"), F.lit(False)).alias("ok"), F.col(f"d_{i}").alias("detail")) for i, k in enumerate(checks)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def recomputed(df: DataFrame, key: str, stored: dict[str, str], fresh: dict[str, Column]) -> DataFrame:
    """V4: (key, column) of stored values that do not come out again, nulls compared too."""
    bad = F.filter(F.array(*[F.when(~F.col(stored[c]).eqNullSafe(f), F.lit(c)) for c, f in fresh.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(bad).alias("column"))


def same_settings(a: dict, b: dict, keys: list[str]) -> list[str]:
    """V5: settings in which two runs differ; a comparison needs none."""
    return [k for k in keys if a.get(k) != b.get(k) or k not in a or k not in b]


def comparison_gate(a: DataFrame, b: DataFrame, locked: DataFrame, key: str, content: list[str], settings: tuple[dict, dict], keys: list[str], digests: dict[str, tuple[str | None, str | None]]) -> DataFrame:
    """V5: (check, ok, detail) of what must hold before two runs over a locked set are compared: settings are
    there and equal; digests (found, expected) of data and weights agree; each run has every locked
    key once and no other, with the locked content."""
    rows = [(f"setting {k}", k not in same_settings(*settings, keys), f"{settings[0].get(k)!r}, {settings[1].get(k)!r}") for k in keys]
    rows += [(f"digest {k}", found is not None and found == wanted, "") for k, (found, wanted) in digests.items()]
    out = a.sparkSession.createDataFrame(rows, "check string, ok boolean, detail string")
    text = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    kept = locked.select(F.col(key).alias("_key"), text.alias("_locked"))
    for name, run in (("first", a), ("second", b)):
        own = run.groupBy(F.col(key).alias("_run_key")).agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("_text"))
        d = kept.join(own, F.col("_key").eqNullSafe(F.col("_run_key")), "full_outer")
        lacks, more = F.count_if(F.col("n").isNull()), F.count_if(F.col("_locked").isNull())
        twice, differ = F.count_if(F.col("n") > 1), F.count_if(F.col("_text") != F.col("_locked"))
        checks = F.array(*[F.struct(F.lit(f"{name} run {what}").alias("check"), (n == 0).alias("ok"), n.cast("string").alias("detail")) for what, n in (("covers the set", lacks), ("has no other rows", more), ("has no row twice", twice), ("has the locked content", differ))])
        out = out.union(d.agg(checks.alias("c")).select(F.explode("c").alias("c")).select("c.*"))
    return out


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """V6: rows and an order-free digest; equal for equal reruns."""
    cols = sorted(df.columns)
    h = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in cols]).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()
    return r["n"], str(r["h"])


def reruns_equal(make: Callable[[], DataFrame]) -> bool:
    return fingerprint(make()) == fingerprint(make())


def balanced(df: DataFrame, label: str, split: str, labels: int) -> DataFrame:
    """V7: per split: rows, whether every label has as many, and whether rows are a multiple of the labels."""
    c = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(split).agg(F.sum("n").alias("n"), ((F.min("n") == F.max("n")) & (F.count(F.lit(1)) == labels)).alias("balanced"), (F.sum("n") % labels == 0).alias("whole"))
