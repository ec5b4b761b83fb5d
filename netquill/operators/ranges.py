"""Running sums, neighbours and quantiles over ordered values without one task per column.

The values of a key are dealt into ranges between approximate quantiles. A window
then runs within a range, and the ranges' totals, at most BUCKETS for each key,
carry over what lies before or after it. Results are exact whatever the cuts are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], F.lit(True))


def dealt(df: DataFrame, keys: list[str], order: str, buckets: int = BUCKETS) -> DataFrame:
    """df and nq_part, the range that the order value lies in; keys: few different ones, such as columns."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000).alias("nq_cuts"))
    cuts = cuts.select(*[F.col(k).alias(f"nq_of_{k}") for k in keys], F.array_distinct("nq_cuts").alias("nq_cuts"))
    part = F.size(F.filter(F.coalesce("nq_cuts", F.array().cast("array<double>")), lambda c: c <= F.col(order)))
    return df.join(F.broadcast(cuts), _same(keys, "nq_of_"), "left").withColumn("nq_part", part).drop("nq_cuts", *[f"nq_of_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: str, sums: list[str], buckets: int = BUCKETS) -> DataFrame:
    """df with c_<s>, the sum up to and with the row's order value, t_<s>, the key's whole sum, and next, the next greater order value.

    An order value stands in one row of a key at most.
    """
    rows = dealt(df, keys, order, buckets)
    totals = rows.groupBy(*keys, "nq_part").agg(F.min(order).alias("nq_low"), *[F.sum(s).alias(f"nq_{s}") for s in sums])
    along = Window.partitionBy(*keys).orderBy("nq_part")  # over a key's ranges
    before, whole = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    carried = [c for s in sums for c in (F.coalesce(F.sum(f"nq_{s}").over(before), F.lit(0)).alias(f"nq_before_{s}"), F.sum(f"nq_{s}").over(whole).alias(f"t_{s}"))]
    totals = totals.select(*[F.col(k).alias(f"nq_of_{k}") for k in keys], F.col("nq_part").alias("nq_of_part"), F.lead("nq_low").over(along).alias("nq_after"), *carried)
    own = Window.partitionBy(*keys, "nq_part").orderBy(order)
    got = rows.select("*", F.lead(order).over(own).alias("nq_next"), *[F.sum(s).over(own).alias(f"nq_own_{s}") for s in sums])
    got = got.join(F.broadcast(totals), _same(keys, "nq_of_") & (F.col("nq_part") == F.col("nq_of_part")))
    return got.select(*df.columns, F.coalesce("nq_next", "nq_after").alias("next"), *[c for s in sums for c in ((F.col(f"nq_own_{s}") + F.col(f"nq_before_{s}")).alias(f"c_{s}"), F.col(f"t_{s}"))])


def quantiles(counts: DataFrame, keys: list[str], value: str, n: str, shares: list[float]) -> DataFrame:
    """(keys, q array<double>): exact quantiles, linear between ranks, of values that stand n times each."""
    run = running(counts.where(F.col(n) > 0), keys, value, [n])
    picks = []
    for share in shares:
        at = F.lit(float(share)) * (F.col(f"t_{n}") - 1)
        for rank in (F.floor(at), F.ceil(at)):
            picks.append(F.max(F.when((F.col(f"c_{n}") > rank) & (F.col(f"c_{n}") - F.col(n) <= rank), F.col(value).cast("double"))))
    got = run.groupBy(*keys).agg(F.first(f"t_{n}").alias("nq_t"), *[p.alias(f"nq_q{i}") for i, p in enumerate(picks)])
    cells = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("nq_t") - 1)
        low, high = F.col(f"nq_q{2 * i}"), F.col(f"nq_q{2 * i + 1}")
        cells.append(low + (high - low) * (at - F.floor(at)))
    return got.select(*keys, F.array(*cells).alias("q"))


def neighbours(df: DataFrame, keys: list[str], order: str, known: str, buckets: int = BUCKETS) -> DataFrame:
    """df with below and above: the nearest order values, the row's own too, of rows where known is true."""
    rows = dealt(df, keys, order, buckets)
    mark = F.when(F.col(known), F.col(order))
    edges = rows.groupBy(*keys, "nq_part").agg(F.min(mark).alias("nq_low"), F.max(mark).alias("nq_high"))
    along = Window.partitionBy(*keys).orderBy("nq_part")
    edges = edges.select(*[F.col(k).alias(f"nq_of_{k}") for k in keys], F.col("nq_part").alias("nq_of_part"), F.max("nq_high").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("nq_before"), F.min("nq_low").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("nq_after"))
    own = Window.partitionBy(*keys, "nq_part")
    up, down = own.orderBy(order).rangeBetween(Window.unboundedPreceding, 0), own.orderBy(F.col(order).desc()).rangeBetween(Window.unboundedPreceding, 0)
    got = rows.select("*", F.max(mark).over(up).alias("nq_b"), F.min(mark).over(down).alias("nq_a"))
    got = got.join(F.broadcast(edges), _same(keys, "nq_of_") & (F.col("nq_part") == F.col("nq_of_part")))
    return got.select(*df.columns, F.coalesce("nq_b", "nq_before").alias("below"), F.coalesce("nq_a", "nq_after").alias("above"))
