"""Quality rules: word statistics, base rules, and robust multivariate outliers.

Only DataFrame functions run here.  Each text gives five counts; five transforms
of them form a vector.  Per language and source, the minimum-covariance-
determinant estimate of centre and scatter is found by concentration steps from
two deterministic starts (per-coordinate medians and deviations; spatial signs):
the rows are ranked by Mahalanobis distance, centre and scatter are taken anew from
the closest ``subset`` share until no determinant falls, and the start that ends with the
smaller determinant wins.  A reweighted estimate from the rows within the usual
distance follows, and rows beyond the cutoff are rejected.

A step is one pass over the vectors.  Rows are ranked by bins of their distance, 32 to
an octave: each group's count and moments per bin combine before the shuffle, and
the closest share is the bins up to the one that reaches it, whole.  So a source with a
third of all rows costs a task no more than any other.  The bins of the last step also
give the median that makes the scatter consistent and the reweighted moments.

Sources with fewer than ``least_rows`` fitted rows (five to a coordinate), of which no scatter can
be told, are one group per language; languages whose rest is as small are one
group; if that is still as small, its rows are only judged by the base rules.  ``level`` (0 to
3) says which held for a row.  The scatter's pivots are at least FLOORS squared.
"""

from __future__ import annotations

from itertools import count
from math import sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, tasks

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
P = 5
Z = [f"z{i}" for i in range(P)]
#: Least standard deviations of the coordinates, given the ones before.  Most texts have no symbols and no
#: repeats, so the scatter of these is often zero; a deviation counts by these units then.  At the cutoff alone they
#: are a factor of 1.3 in word length, 3 % symbols and 40 % of the lines repeated; repeated words that pass
#: the base rule only add to another deviation, so that a heading that comes twice is no outlier.
FLOORS = (0.8, 0.05, 0.25, 0.29, 0.33)
#: A step that lowers the log determinant by less has settled.
SETTLED = 1e-3
#: Bins to an octave of squared distance.
BINS = 32


def chi2_quantile(p: float, k: int) -> float:
    """Wilson-Hilferty approximation."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * sqrt(2 / (9 * k))) ** 3


def text_statistics(docs: DataFrame, id_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    """id, kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).where("id IS NOT NULL")
    d = d.withColumn("trimmed", F.trim(F.col("t"), F.lit(SPACES)))
    d = d.withColumn("w", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+")))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("w"), i + k) for k in range(WINDOW))))
    d = d.withColumn("h", F.when(F.size("w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""))
    d = d.select(
        "id", *[c for c in d.columns if c not in ("id", "t", "trimmed", "w", "h", "lines")],
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        # positions with their window's hash, by hash, where any hash occurs twice
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"),
    )
    same = lambda k, j: F.get(F.col("s"), k)["x"] == F.get(F.col("s"), j)["x"]
    d = d.withColumn("p", F.filter(F.transform("s", lambda x, k: F.when(F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)), x["i"])), lambda i: i.isNotNull()))
    d = d.withColumn("p", F.array_sort("p"))
    covered = F.aggregate(F.transform("p", lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(F.col("p"), k + 1) - x), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("s", "p")


def _vector(d: DataFrame) -> DataFrame:
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.greatest(F.col("n_lines"), F.lit(1))
    return d.withColumns({
        "z0": F.log1p(n.cast("double")),
        "z1": F.log((chars + 100) / (n + 20)),
        "z2": F.log1p(100.0 * F.col("n_symbols") / F.greatest(chars, F.lit(1))),
        "z3": F.log1p(10.0 * F.col("n_dup_lines") / lines),
        "z4": F.log1p(10.0 * F.col("n_repeat_words") / F.greatest(n, F.lit(1))),
    })


GROUP = ["level", "g_lang", "g_source"]
MEAN = [f"m{i}" for i in range(P)]
CHOL = [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


SUMS = ["n", *[f"a{i}" for i in range(P)], *[f"q{i}{j}" for i in range(P) for j in range(i + 1)]]


def _groups(df: DataFrame, name: str) -> DataFrame:
    """A stored table of a row for each group or a few.  In few files, as the planner judges by their size
    whether it can be broadcast; sources may be many, and then it is not."""
    return stored(df.coalesce(max(1, tasks(df.sparkSession) // 32)), name)


def _moments(sums: DataFrame, by: list[str], *keep: str) -> DataFrame:
    """Mean and scatter (s{i}{j}) of added-up SUMS per group."""
    out = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS], *[F.first(c).alias(c) for c in keep])
    out = out.withColumns({f"m{i}": F.col(f"a{i}") / F.col("n") for i in range(P)})
    return out.select(*by, *keep, *MEAN, *[(F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)])


def _binned(d: DataFrame, by: list[str]) -> DataFrame:
    """SUMS of the vectors per group and bin of their distance d2; the bin's bounds are
    2 ** (bin / BINS) and 2 ** ((bin + 1) / BINS)."""
    z = [F.col(c) for c in Z]
    d = d.withColumn("bin", F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-9))) * BINS).cast("int"))
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(z[i]).alias(f"a{i}") for i in range(P)], *[F.sum(z[i] * z[j]).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)]]
    d = d.groupBy(*by, "bin").agg(*sums)
    before = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # a few hundred bins each
    return d.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "rows": F.sum("n").over(W.partitionBy(*by))})


def _cholesky(d: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Replace scatter s by its lower triangle l, whose diagonal is at least floors, and add its log determinant."""
    for i in range(P):
        for j in range(i + 1):
            c = F.col(f"s{i}{j}")
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            d = d.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(max(floors[i] ** 2, 1e-12)))) if i == j else c / F.col(f"l{j}{j}"))
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log(F.col("l00"))) * 2
    return d.withColumn("logdet", logdet).drop(*[f"s{i}{j}" for i in range(P) for j in range(i + 1)])


def _distance(d: DataFrame, name: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution with the triangle l."""
    for i in range(P):
        c = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(i):
            c = c - F.col(f"l{i}{k}") * F.col(f"y{k}")
        d = d.withColumn(f"y{i}", c / F.col(f"l{i}{i}"))
    return d.withColumn(name, sum((F.col(f"y{i}") ** 2 for i in range(1, P)), F.col("y0") ** 2)).drop(*[f"y{i}" for i in range(P)])


def mcd_estimates(fit: DataFrame, *, subset: float = 0.75, steps: int | None = None, accuracy: int = 2000, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """One row per group of fit (GROUP and Z columns): mean, and the triangle of the
    reweighted scatter.  Sizes of groups are not limited; each step is one pass."""
    by, state = [*GROUP, "start"], [*MEAN, *CHOL, "logdet"]
    med = _groups(fit.groupBy(*GROUP).agg(*[F.percentile_approx(z, 0.5, accuracy).alias(f"c{i}") for i, z in enumerate(Z)]), "mcd-median")
    mad = fit.join(med, GROUP).groupBy(*GROUP).agg(*[F.percentile_approx(F.abs(F.col(z) - F.col(f"c{i}")), 0.5, accuracy).alias(f"d{i}") for i, z in enumerate(Z)])
    scale = _groups(med.join(mad, GROUP).withColumns({f"d{i}": F.greatest(1.4826 * F.col(f"d{i}"), F.lit(floors[i])) for i in range(P)}), "mcd-scale")
    units = [(F.col(f"z{i}") - F.col(f"c{i}")) / F.col(f"d{i}") for i in range(P)]
    signs = fit.join(scale, GROUP).withColumns({f"u{i}": u for i, u in enumerate(units)}).withColumn("r2", F.greatest(sum((F.col(f"u{i}") ** 2 for i in range(1, P)), F.col("u0") ** 2), F.lit(1e-9)))
    sign = signs.groupBy(*GROUP).agg(*[F.avg(P * F.col(f"u{i}") * F.col(f"u{j}") / F.col("r2")).alias(f"k{i}{j}") for i in range(P) for j in range(i + 1)])
    both = scale.join(sign, GROUP).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumns({f"m{i}": F.col(f"c{i}") for i in range(P)})
    for i in range(P):
        for j in range(i + 1):
            diagonal = F.lit(1.0 if i == j else 0.0)
            both = both.withColumn(f"s{i}{j}", F.col(f"d{i}") * F.col(f"d{j}") * F.when(F.col("start") == 0, diagonal).otherwise(F.col(f"k{i}{j}")))
    first = _cholesky(both.select(*by, *MEAN, *[f"s{i}{j}" for i in range(P) for j in range(i + 1)]), floors)
    # the starts' scatter is of no subset, so any first step improves on it
    params = _groups(first.withColumn("logdet", F.lit(float("inf"))), "mcd-start")
    for step in count():
        bins = _groups(_binned(_distance(fit.join(params, GROUP)), by), f"mcd-bins{step}")
        new = _cholesky(_moments(bins.where(F.col("before") < subset * F.col("rows")), by), floors)
        old = params.select(*by, *[F.col(c).alias(f"old_{c}") for c in state])
        better = F.col("logdet") < F.col("old_logdet") - SETTLED  # else a group stays at its last estimate
        now = _groups(new.join(old, by).select(*by, *[F.when(better, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in state], better.alias("moved")), f"mcd-step{step}")
        if now.where("moved").isEmpty() or step + 1 == steps:
            break
        params = now.drop("moved")
    least = params.groupBy(*GROUP).agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    bins = bins.join(least, by).withColumn("top", F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS))
    # the scatter is made consistent by the median distance, then taken anew from the rows within the usual one
    median = bins.where(F.col("before") + F.col("n") >= 0.5 * F.col("rows")).groupBy(*GROUP).agg(F.min("top").alias("median"))
    within = bins.join(median, GROUP).where(F.col("top") <= F.greatest(F.col("median") / chi2_quantile(0.5, P), F.lit(1.0)) * chi2_quantile(0.975, P))
    return _groups(_cholesky(_moments(within, GROUP), floors).drop("logdet"), "mcd-final")


def fit_groups(rows: DataFrame, least_rows: int) -> DataFrame:
    """(lang_, source_) of rows with the group that judges them: its level, g_lang and g_source."""
    sizes = rows.groupBy("lang_", "source_").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < least_rows, F.col("n"))
    sizes = sizes.withColumn("rest", F.sum(small).over(W.partitionBy("lang_")))
    over = F.col("n") >= least_rows
    sizes = sizes.withColumn("level", F.when(over, 0).when(F.col("rest") >= least_rows, 1).otherwise(2))
    left = sizes.where("level = 2").agg(F.sum("n").alias("left"))  # one row
    sizes = sizes.crossJoin(F.broadcast(left)).withColumn("level", F.when((F.col("level") == 2) & (F.col("left") < least_rows), 3).otherwise(F.col("level")))
    lang, source = F.when(F.col("level") < 2, F.col("lang_")).otherwise(""), F.when(F.col("level") < 1, F.col("source_")).otherwise("")
    return sizes.select("lang_", "source_", "level", lang.alias("g_lang"), source.alias("g_source"))


def robust_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, tail: float = 1e-5, least_rows: int = 5 * P, subset: float = 0.75, steps: int | None = None) -> DataFrame:
    """One row per row of docs: id, the statistics, base_failed, level, distance2 (squared
    Mahalanobis distance; null, as level, where base_failed, and at level 3) and kept.

    Base rule: under 10 words, or over a fifth of the words in repeated 5-word windows.
    Null text is empty text and fails; null language or source count as the empty
    string; repeated rows are rows of their own; rows with a null id are left out.
    An empty table gives an empty result.  tail is the share of rows of a clean,
    normal group that the cutoff gives up; a distance equal to the cutoff is kept.  steps bounds
    the concentration steps, which otherwise go on until no determinant falls.
    """
    keep = [F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang_"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_")]
    stats = _vector(text_statistics(docs, id_col, text_col, keep))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stored(stats.withColumn("base_failed", failed), "quality-stats")
    groups = _groups(fit_groups(stats.where("NOT base_failed"), least_rows), "quality-groups")
    fit = stats.where("NOT base_failed").join(groups.where("level < 3"), ["lang_", "source_"]).select(*GROUP, *Z)
    chosen = _groups(groups.join(mcd_estimates(fit, subset=subset, steps=steps), GROUP, "left").drop("g_lang", "g_source"), "quality-estimates")
    out = _distance(stats.join(chosen, ["lang_", "source_"], "left"), "distance2")
    of_fit = lambda c: F.when(~F.col("base_failed"), F.col(c)).alias(c)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi2_quantile(1 - tail, P), F.lit(True))
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", of_fit("level"), of_fit("distance2"), kept.alias("kept"))
