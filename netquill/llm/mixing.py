"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source (combined before the shuffle), a target per source
follows by water filling in one window over the per-source rows, and a document
is emitted floor(rate) times plus one hash-seeded Bernoulli copy with
probability equal to the fraction. The hash depends on the row alone, so reruns
and any partitioning agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.llm.common import n_words, row_of, stash


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size long, target double) from rows of (source, size).

    Sources by code point, null last, take the weights in turn. The total is
    share times all sizes. A target above ceiling times its source's size stops
    there and its excess goes to the others by weight: with the sources in order
    of ceiling * size / weight, the level after k stops is (total - stopped) /
    (weight left), and its greatest value is the level of those that don't stop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1))
    per = per.withColumn("cap", F.lit(ceiling) * F.col("source_size").cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    return per.select("source", "source_size", F.least("cap", F.col("w") * F.max("level").over(every)).alias("target"))


def draw(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the row's values alone."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(size: Column, source_size: Column, target: Column, u: Column) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def _planned(rows: DataFrame, id_col: str, seed: str, **targets) -> DataFrame:
    per = stash(source_targets(rows.select("source", "size"), **targets), "targets").withColumnRenamed("source", "of")
    return rows.join(per, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("copies", copies(F.col("size"), F.col("source_size"), F.col("target"), draw(seed, F.col(id_col), F.col("size"))))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **targets) -> DataFrame:
    """One row per document: (id, size, source_size, target, taken, copies).

    Null texts have size 0; null sources form one source; rows without an id
    draw by their size alone; repeated rows get equal decisions. A source
    without words has target 0 and is not emitted. Texts are counted whole. Sources
    whose ceiling comes at the same level (ties) go by name. Other columns are left
    out. An empty table gives an empty result.
    """
    rows = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    got = _planned(rows, "id", seed, **targets)
    return got.select("id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **targets) -> DataFrame:
    """docs with each row repeated as mix_plan() decides; the same columns, whatever their names.

    Nulls, empty and very long texts, repeated rows and empty tables are taken as
    mix_plan() says: a text without words has size 0 and still draws its copies.
    """
    rows = docs.select(row_of(docs), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    got = _planned(rows, "id", seed, **targets)
    return got.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")
