"""Rank correlation and mutual information between columns."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.operators import ranges
from netquill.operators.clean import melt_numbers


def average_ranks(df: DataFrame, columns: list[str], side: str = "syn") -> DataFrame:
    """df's columns as r_<column>: the average rank on its side.

    Ranks come from value counts (running sums over distinct values), joined
    back by value, so no window runs over all rows.
    """
    counts = melt_numbers(df, columns, [side]).where("value is not null").groupBy("column", side, "value").agg(F.count("*").alias("n"))
    ranks = ranges.running(counts, ["column", side], "value", ["n"]).select("column", side, "value", (F.col("c_n") - (F.col("n") - 1) / 2).alias("rank"))
    out = df.select(side, *columns)
    for c in columns:
        one = ranks.where(F.col("column") == c).select(F.col(side).alias("nq_side"), F.col("value").alias("nq_value"), F.col("rank").alias(f"r_{c}"))
        out = out.join(one, (F.col(side) == F.col("nq_side")) & (F.col(c).cast("double") == F.col("nq_value")), "left").drop("nq_side", "nq_value")
    return out


def spearman(df: DataFrame, columns: list[str], side: str = "syn") -> DataFrame:
    """(side, a, b, rho) for every ordered pair."""
    ranked = average_ranks(df, columns, side)
    row = ranked.groupBy(side).agg(*[F.corr(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in combinations(columns, 2)])
    cell = lambda a, b: F.lit(1.0) if a == b else F.col(f"`{a}|{b}`" if columns.index(a) < columns.index(b) else f"`{b}|{a}`")
    return row.select(side, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(a, b).alias("rho")) for a, b in product(columns, columns)])).alias("x")).select(side, "x.*")


def correlation_difference(matrix: DataFrame, side: str = "syn") -> DataFrame:
    """One row (mean_gap, std_gap) of |rho_a - rho_b| over the whole matrix, diagonal included; population deviation."""
    pick = lambda s: F.max(F.when(F.col(side) == F.lit(s), F.col("rho")))
    gap = matrix.groupBy("a", "b").agg(F.abs(pick(False) - pick(True)).alias("gap"))
    return gap.agg(F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"))


def mutual_information(df: DataFrame, columns: list[str], side: str = "syn") -> DataFrame:
    """(side, a, b, mi) in nats for each pair a < b: one shuffle for all pairs' joint counts, margins from those."""
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(columns, 2)])
    joint = df.select(side, F.explode(cells).alias("p")).select(side, "p.*").where("x is not null and y is not null").groupBy(side, "a", "b", "x", "y").agg(F.count("*").cast("double").alias("n"))
    pair = [side, "a", "b"]
    sums = lambda name, *by: joint.groupBy(*pair, *by).agg(F.sum("n").alias(name))
    full = joint.join(sums("n_x", "x"), [*pair, "x"]).join(sums("n_y", "y"), [*pair, "y"]).join(F.broadcast(sums("t")), pair)
    return full.groupBy(*pair).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("n_x") * F.col("n_y")))).alias("mi"))
