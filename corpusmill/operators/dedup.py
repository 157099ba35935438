"""Exact and near-duplicate removal that keeps the first row, and label contradictions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_space
from ..sources.io import pinned
from .similarity import set_pairs


def _digest(c: Column | str) -> Column:
    """What a key is grouped by: a shuffle moves 32 bytes a row, however long the text is."""
    return F.sha2((F.col(c) if isinstance(c, str) else c).cast("string").cast("binary"), 256)


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; of rows that tie on order too, one.

    The first order value of a key is a minimum that combines before the shuffle, so a key
    with a third of all rows is no hot task; a window would gather its rows."""
    d = df.withColumn("_digest", _digest(key))
    first = d.groupBy(F.col("_digest").alias("_first_key")).agg(F.min(order).alias("_first"))
    won = d.join(first, F.col("_digest").eqNullSafe(F.col("_first_key")) & F.col(order).eqNullSafe(F.col("_first")))
    return won.dropDuplicates(["_digest", "_first"]).drop("_first_key", "_first", "_digest")


def text_key(text_col: str) -> Column:
    """D3: by which copies of a text are known: a digest of it without white space."""
    return _digest(norm_space(text_col))


def drop_contradictions(df: DataFrame, text_col: str, label: str, keyed: bool = False) -> DataFrame:
    """D3: no copy of a text that stands under more than one label.  keyed: text_col has text_key() of the texts, so
    that a caller who needs no texts works them out once and moves none."""
    d = df.withColumn("_key", F.col(text_col) if keyed else text_key(text_col))
    bad = d.groupBy("_key").agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a <> _b").select("_key")
    return d.join(bad, "_key", "left_anti").drop("_key")


def merge_groups(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """One row, the first, of each key whose rows agree on the label; rows with an empty key go."""
    d = df.where(F.col(key) != "").withColumn("_digest", _digest(key))
    g = d.groupBy("_digest").agg(F.min(label).alias("_a"), F.max(label).alias("_b"), F.min(order).alias("_first")).where("_a <=> _b")
    won = d.join(g.select("_digest", F.col("_first").alias(order)), ["_digest", order], "left_semi")
    return won.dropDuplicates(["_digest", order]).drop("_digest")


def gram_classes(df: DataFrame, row: str, grams: str, block: list[str] | None = None) -> DataFrame:
    """(row, rep): rows with equal, non-empty gram sets (and equal block columns) have the least of them as rep.

    A group of equal texts, however large, takes part in a similarity join as one row."""
    d = df.where(F.size(grams) > 0).select(F.col(row).alias("row"), *(block or []), _digest(F.to_json(F.array_sort(grams))).alias("_digest"))
    d = pinned(d)
    first = d.groupBy("_digest", *(block or [])).agg(F.min("row").alias("rep"))
    same = F.col("d._digest") == F.col("f._digest")
    for c in block or []:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}"))
    return d.alias("d").join(first.alias("f"), same).select("row", "rep")


def _hashed(frames: list[DataFrame]) -> list[DataFrame]:
    """frames (row, g, ...) with the strings of g as 64-bit hashes, by a seed under which no two of them meet."""
    every = reduce(DataFrame.union, [x.select(F.explode("g").alias("gram")) for x in frames])
    words = pinned(every.distinct())
    for seed in count():
        code = partial(F.xxhash64, F.lit(seed))
        if words.groupBy(code("gram").alias("code")).count().where("count > 1").isEmpty():
            return [x.withColumn("g", F.transform("g", lambda w: code(w))) for x in frames]  # noqa: B023


def _coded(frames: list[DataFrame], row: str, grams: str, block: list[str]) -> tuple[list[DataFrame], bool]:
    """Each frame as (row, id long, g array<long>, label string), without rows that have no grams; whether id is the row."""
    out = [x.where(F.col(row).isNotNull() & (F.size(grams) > 0)).select(F.col(row).alias("row"), F.col(grams).alias("g"), F.to_json(F.struct(*block)).alias("label") if block else F.lit("").alias("label")) for x in frames]
    out = [pinned(x) for x in (_hashed(out) if dict(out[0].dtypes)["g"] == "array<string>" else [x.withColumn("g", F.col("g").cast("array<bigint>")) for x in out])]
    whole = all(dict(x.dtypes)["row"] in ("tinyint", "smallint", "int", "bigint") for x in out)
    plain = whole and all(x.groupBy("row").count().where("count > 1").isEmpty() for x in out)
    return [x.withColumn("id", F.col("row").cast("long")) if plain else pinned(x.withColumn("id", F.monotonically_increasing_id())) for x in out], plain


def _pairs(left: DataFrame, right: DataFrame | None, plain: bool, threshold: float) -> DataFrame:
    """(a, b, similarity) by rows, of what _coded() returns."""
    found = set_pairs(left, threshold, right)
    if not plain:
        a, b = (x.select(F.col("id").alias(c), F.col("row").alias(f"row_{c}")) for x, c in ((left, "a"), (left if right is None else right, "b")))
        found = found.join(a, "a").join(b, "b")
        if right is None:
            found = found.where("row_a <> row_b").select(F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b"), "similarity")
        found = found.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"), "similarity").distinct()
    kinds = [dict(x.dtypes)["row"] for x in (left, left if right is None else right)]
    return found.select(*[F.col(c).cast(k).alias(c) for c, k in zip("ab", kinds, strict=True)], "similarity")


def similar_pairs(df: DataFrame, row: str, grams: str, threshold: float, other: DataFrame | None = None, block: list[str] | None = None) -> DataFrame:
    """(a, b, similarity) of rows whose gram sets have at least the Jaccard similarity.

    Exact, by similarity.set_pairs().  With other, pairs are between the two tables; else a < b by the order of row.
    block: columns that must agree, such as the label.  Grams are strings, or whole numbers that stand for them.
    Empty sets are similar to nothing.  Rows with equal sets are paired one by one here;
    similar_classes() takes them together first."""
    frames, plain = _coded([df] if other is None else [df, other], row, grams, block or [])
    return _pairs(frames[0], None if other is None else frames[1], plain, threshold)


def similar_classes(df: DataFrame, row: str, grams: str, threshold: float, block: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): similar_pairs() between rows that represent their equals, and (row, rep) of all
    rows that have grams."""
    df = pinned(df.select(row, grams, *(block or [])))
    members = pinned(gram_classes(df, row, grams, block))
    reps = df.join(members.where("row = rep").select(F.col("row").alias(row)), row, "left_semi")
    return similar_pairs(reps, row, grams, threshold, block=block), members


#: Edges of a component, or of all of them, that one task settles by itself.
SMALL_COMPONENT = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (late, early; late > early): root is the least node of a component.

    Alternating stars: in turn every larger and every smaller neighbour of a node is linked to the least node around
    it, until nothing changes; the number of rounds grows with the logarithm of a component's longest path.  A least
    neighbour is a minimum that combines before its shuffle."""
    links = pinned(edges.select(F.col("late").alias("u"), F.col("early").alias("v")).distinct())
    sign = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = None
    while (now := sign(links)) != before:
        before = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        around = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = pinned(around.union(least.select("u", F.col("m").alias("v"))).distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())


def _settle(edges: DataFrame) -> DataFrame:
    """(late) of rows that go: whole components are dealt to tasks, which go through their edges in order and hold the
    rows of one component that went."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(edges.dtypes)["late"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, gone = None, set()
        for b in batches:
            out = []
            for root, late, early in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if root != of:
                    of, gone = root, set()
                if late not in gone and early not in gone:
                    gone.add(late)
                    out.append(late)
            yield pa.RecordBatch.from_arrays([pa.array(out, b.column(1).type)], names=["late"])

    dealt = edges.select("root", "late", "early").repartition(n, "root").sortWithinPartitions("root", "late", "early")
    return dealt.mapInArrow(run, f"late {kind}")


def _settle_in_rounds(edges: DataFrame) -> DataFrame:
    """(late) of rows that go, for components of any size: a row with no earlier neighbour left is kept, and a row with a
    kept earlier neighbour goes.  Each round is two anti-joins over what is not settled; there are as many as
    links in the longest chain, and each settles the least row of every component at least."""
    gone = edges.select("late").limit(0)
    while not edges.isEmpty():
        waiting = edges.select(F.col("late").alias("early")).distinct()
        kept = edges.select("early").distinct().join(waiting, "early", "left_anti")
        lost = edges.join(kept, "early", "left_semi").select("late").distinct()
        gone = pinned(gone.union(lost))
        done = edges.join(lost, "late", "left_anti")  # lost rows wait for nothing
        edges = pinned(done.join(lost.select(F.col("late").alias("early")), "early", "left_anti"))
    return gone


def greedy_drop(df: DataFrame, row: str, pairs: DataFrame, small: int = SMALL_COMPONENT) -> DataFrame:
    """Rows that survive when each row in order goes if it is similar to a kept one before it.

    What becomes of a row depends on its component of similar rows alone.  Components of up to small edges are
    settled in one pass, each within a task; larger ones in rounds over all tasks.  Few pairs in all are one pass."""
    edges = pinned(pairs.select(F.greatest("a", "b").alias("late"), F.least("a", "b").alias("early")).distinct())
    if edges.count() <= small:
        gone = _settle(edges.withColumn("root", F.lit(0)))
    else:
        rooted = pinned(edges.join(components(edges).withColumnRenamed("node", "late"), "late"))
        sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > small).select("root")
        gone = _settle(rooted.join(large, "root", "left_anti")).union(_settle_in_rounds(pinned(rooted.join(large, "root", "left_semi").select("late", "early"))))
    return df.join(gone.select(F.col("late").alias(row)), row, "left_anti")


#: Rows of the first round of a greedy removal, and how much larger each next round is.
FIRST_ROUND, GROWTH = 2048, 8


def drop_near_duplicates(df: DataFrame, row: str, grams: str, threshold: float = 0.85, block: list[str] | None = None) -> DataFrame:
    """Greedy, in the order of row, within the block; rows without grams go.

    A later row with an earlier one's grams goes whatever becomes of the earlier one, and decides
    over no other row, so only the first of equal rows is asked.  Rows are settled in rounds, in their order: pairs are made
    among the rows of a round, and those that are kept remove what is similar to them from all later ones.  A large family is gone
    after the first round, so it costs a comparison a row."""
    block = block or []
    sets = pinned(df.select(row, grams, *block))
    members = gram_classes(sets, row, grams, block)
    reps = sets.join(members.where("row = rep").select(F.col("row").alias(row)), row, "left_semi")
    (left,), plain = _coded([reps], row, grams, block)
    todo, kept, size = left.count(), [], FIRST_ROUND
    while todo:
        now = left
        if todo > 2 * size:
            bound = left.select("row").orderBy("row").limit(size).agg(F.max("row").alias("bound"))
            now = pinned(left.join(F.broadcast(bound), F.col("row") <= F.col("bound"), "left_semi"))
        stay = pinned(greedy_drop(now, "row", _pairs(now, None, plain, threshold)))
        kept.append(stay.select("row"))
        if now is left:
            break
        later = left.join(F.broadcast(bound), F.col("row") > F.col("bound"), "left_semi")
        gone = _pairs(later, stay, plain, threshold).select(F.col("a").alias("row")).distinct()
        left = pinned(later.join(gone, "row", "left_anti"))
        todo, size = left.count(), size * GROWTH
    if not kept:
        return df.limit(0)
    return df.join(reduce(DataFrame.union, kept).withColumnRenamed("row", row), row, "left_semi")


def drop_similar_to(df: DataFrame, row: str, grams: str, external: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Rows similar to no external one.  Equal external rows are compared once."""
    theirs = gram_classes(external, row, grams).where("row = rep").select(F.col("row").alias(row))
    hit = similar_pairs(df, row, grams, threshold, other=external.join(theirs, row, "left_semi")).select(F.col("a").alias(row)).distinct()
    return df.join(hit, row, "left_anti")
