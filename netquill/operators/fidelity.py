"""How a synthetic table differs from the original, column by column and pair by pair.

Every single-column measure starts from one frame of value frequencies
(column, value, n_a, n_b), made by one shuffle for all columns. Running sums are
taken per column over distinct values, not over rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.operators import ranges
from netquill.operators.clean import melt, melt_numbers


def frequencies(df: DataFrame, columns: list[str], side: str = "syn", numbers: bool = True) -> DataFrame:
    """(column, value, n_a, n_b): rows of the original and of the synthetic side with that value; nulls are left out."""
    cells = (melt_numbers if numbers else melt)(df, columns, [side]).where("value is not null")
    return cells.groupBy("column", "value").agg(F.sum((~F.col(side)).cast("long")).alias("n_a"), F.sum(F.col(side).cast("long")).alias("n_b"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two (value, n) tables as (value, n_a, n_b), zero where one side has no such value; one shuffle, no join."""
    both = a.select("value", F.col("n").alias("n_a"), F.lit(0).cast("long").alias("n_b")).union(b.select("value", F.lit(0).cast("long"), "n"))
    return both.groupBy("value").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))


def _totals(freq: DataFrame) -> DataFrame:
    """freq and its columns' sums; one row a column goes to every task."""
    sums = freq.groupBy(F.col("column").alias("of")).agg(F.sum("n_a").cast("double").alias("t_a"), F.sum("n_b").cast("double").alias("t_b"))
    return freq.join(F.broadcast(sums), F.col("column") == F.col("of")).drop("of")


def _cdfs(freq: DataFrame) -> DataFrame:
    both = ranges.running(freq, ["column"], "value", ["n_a", "n_b"])
    return both.withColumn("gap", F.abs(F.try_divide(F.col("c_n_a").cast("double"), F.col("t_n_a").cast("double")) - F.try_divide(F.col("c_n_b").cast("double"), F.col("t_n_b").cast("double"))))


def distances(freq: DataFrame) -> DataFrame:
    """(column, ks, mean_quantile_error, emd): from the two empirical distribution functions."""
    n = F.col("n_a") + F.col("n_b")
    return _cdfs(freq).groupBy("column").agg(
        F.max("gap").alias("ks"), F.try_divide(F.sum(F.col("gap") * n), F.sum(n).cast("double")).alias("mean_quantile_error"),
        F.coalesce(F.sum(F.col("gap") * (F.col("next") - F.col("value"))), F.lit(0.0)).alias("emd"),
    )


def divergences(freq: DataFrame) -> DataFrame:
    """(column, jsd, kl): Jensen-Shannon distance in nats, and KL of the synthetic side from the original (null where infinite)."""
    p, q = F.try_divide(F.col("n_a"), F.col("t_a")), F.try_divide(F.col("n_b"), F.col("t_b"))
    part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))
    m = (p + q) / 2
    return _totals(freq).groupBy("column").agg(
        F.sqrt(F.greatest(F.lit(0.0), F.sum((part(p, m) + part(q, m)) / 2))).alias("jsd"),
        F.when(F.max(((p == 0) & (q > 0)).cast("int")) == 0, F.sum(part(q, F.when(p > 0, p).otherwise(F.lit(1.0))))).alias("kl"),
    )


def entropy_of(counts: DataFrame, n: str = "n", by: tuple[str, ...] = ("column",), base: float = math.e) -> DataFrame:
    """(by, entropy) of the frequencies n, as log t - sum of n log n / t: one aggregate."""
    x = F.col(n).cast("double")
    got = counts.where(x > 0).groupBy(*by).agg(F.sum(x).alias("nq_t"), F.sum(x * F.log(x)).alias("nq_s"))
    return got.select(*by, ((F.log("nq_t") - F.col("nq_s") / F.col("nq_t")) / math.log(base)).alias("entropy"))


def auto_bins(df: DataFrame, columns: list[str], side: str = "syn") -> DataFrame:
    """(column, side, low, high, n_bins): the bin number that numpy's rule 'auto' takes, the finer of Sturges and Freedman-Diaconis."""
    counts = melt_numbers(df, columns, [side]).where("value is not null").groupBy("column", side, "value").agg(F.count("*").alias("n"))
    q = ranges.quantiles(counts, ["column", side], "value", "n", [0.25, 0.75])
    stats = counts.groupBy("column", side).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").cast("double").alias("n")).join(q, ["column", side])
    wide = F.col("high") - F.col("low")
    sturges, fd = wide / (F.log2("n") + 1), 2 * (F.col("q")[1] - F.col("q")[0]) / F.pow(F.col("n"), 1 / 3)
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    return stats.select("column", side, "low", "high", F.when(wide > 0, F.ceil(wide / width)).otherwise(F.lit(1)).cast("long").alias("n_bins"))


def column_entropies(df: DataFrame, continuous: list[str], categorical: list[str], side: str = "syn") -> DataFrame:
    """(column, side, entropy): of values where categorical, of 'auto' bins where continuous."""
    parts = []
    if categorical:
        parts.append(melt(df, categorical, [side]).where("value is not null").groupBy("column", side, F.col("value").alias("b")).agg(F.count("*").alias("n")))
    if continuous:
        edges = auto_bins(df, continuous, side)
        cells = melt_numbers(df, continuous, [side]).where("value is not null")
        at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("n_bins")), F.col("n_bins") - 1)).otherwise(F.lit(0))
        parts.append(cells.join(F.broadcast(edges), ["column", side]).groupBy("column", side, at.cast("string").alias("b")).agg(F.count("*").alias("n")))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return entropy_of(counts, "n", ("column", side))


def entropy_differences(entropies: DataFrame, side: str = "syn") -> DataFrame:
    """(column, entropy_error): |H_a - H_b| / H_a."""
    pick = lambda b: F.max(F.when(F.col(side) == F.lit(b), F.col("entropy")))
    both = entropies.groupBy("column").agg(pick(False).alias("h_a"), pick(True).alias("h_b"))
    return both.select("column", F.try_divide(F.abs(F.col("h_a") - F.col("h_b")), F.col("h_a")).alias("entropy_error"))


def top_values(freq: DataFrame, k: int, n: str) -> DataFrame:
    """(column, value, n, rank): the k commonest values of each column, ties by value."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col(n).desc(), "value"))
    return freq.where(F.col(n) > 0).withColumn("rank", rank).where(F.col("rank") <= k).select("column", "value", F.col(n).alias("n"), "rank")


def top_recall_error(freq: DataFrame, k: int, tolerance: float = 0.0) -> DataFrame:
    """(column, k, tolerance, recall_error): share of the original's top values that no synthetic top value is near.

    near: within tolerance times the original's range. Each side's nearest
    neighbour below and above is found in one ordered pass over the 2 k top values
    of a column, not by comparing all with all.
    """
    a = top_values(freq, k, "n_a").select("column", "value", F.lit(True).alias("own"))
    b = top_values(freq, k, "n_b").select("column", "value", F.lit(False).alias("own"))
    span = freq.where("n_a > 0").groupBy("column").agg((F.max("value") - F.min("value")).alias("span"))
    w = Window.partitionBy("column").orderBy("value", "own")
    other = F.when(~F.col("own"), F.col("value"))
    below = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(other, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = a.union(b).select("column", "value", "own", below.alias("below"), above.alias("above")).where("own").join(span, "column")
    reach = F.lit(float(tolerance)) * F.col("span")
    hit = F.coalesce(F.col("value") - F.col("below") <= reach, F.lit(False)) | F.coalesce(F.col("above") - F.col("value") <= reach, F.lit(False))
    return near.groupBy("column").agg((1 - F.avg(hit.cast("double"))).alias("recall_error")).select("column", F.lit(k).alias("k"), F.lit(float(tolerance)).alias("tolerance"), "recall_error")


def pair_cardinality(df: DataFrame, columns: list[str], side: str = "syn") -> DataFrame:
    """(a, b, n_a, n_b, error): distinct value pairs on each side; pairs with a null are left out."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(columns, 2)])
    found = df.select(side, F.explode(pairs).alias("p")).select(side, "p.*").where("x is not null and y is not null").distinct()
    n = found.groupBy("a", "b").agg(F.sum((~F.col(side)).cast("long")).alias("n_a"), F.sum(F.col(side).cast("long")).alias("n_b"))
    return n.withColumn("error", F.try_divide(F.abs(F.col("n_b") - F.col("n_a")).cast("double"), F.col("n_a").cast("double")))


def pair_norms(df: DataFrame, columns: list[str], side: str = "syn") -> DataFrame:
    """(a, b, norm_a, norm_b, error): spectral norms of two columns, scaled to the original's range, from three sums."""
    edge = df.where(~F.col(side)).agg(*[f(c).cast("double").alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    wide = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(F.lit(1.0))
    x = df.crossJoin(F.broadcast(edge)).select(side, *[((F.col(c) - F.col(f"lo_{c}")) / wide(c)).alias(c) for c in columns])
    sums = [F.sum(F.when(F.col(side) == F.lit(s), F.col(a) * F.col(b))).alias(f"{a}|{b}|{int(s)}") for s in (False, True) for a in columns for b in columns if a <= b]
    row = x.agg(*sums)

    def norm(a: str, b: str, s: int) -> Column:
        p, q, r = F.col(f"`{a}|{a}|{s}`"), F.col(f"`{min(a, b)}|{max(a, b)}|{s}`"), F.col(f"`{b}|{b}|{s}`")
        return F.sqrt((p + r + F.sqrt((p - r) * (p - r) + 4 * q * q)) / 2)

    out = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), norm(a, b, 0).alias("norm_a"), norm(a, b, 1).alias("norm_b")) for a, b in combinations(columns, 2)])).alias("p")).select("p.*")
    return out.withColumn("error", F.try_divide(F.abs(F.col("norm_a") - F.col("norm_b")), F.col("norm_a")))


def pooled_frequency_error(freq: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, error): half the summed difference of the shares that values have in both columns pooled."""
    out = None
    pairs = freq.sparkSession.createDataFrame(list(combinations(columns, 2)), "a string, b string")
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("column"))
    both = freq.join(F.broadcast(ends), "column")
    pooled = both.groupBy("a", "b", "value").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    sums = pooled.groupBy(F.col("a").alias("a2"), F.col("b").alias("b2")).agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"))
    shares = pooled.join(F.broadcast(sums), (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).select("a", "b", (F.col("n_a") / F.col("t_a")).alias("p"), (F.col("n_b") / F.col("t_b")).alias("q"))
    out = shares.groupBy("a", "b").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("error"))
    return out


def joint_frequency_error(df: DataFrame, a: str, b: str, side: str = "syn") -> DataFrame:
    """One row: half the summed difference of the joint shares of (a, b)."""
    n = df.groupBy(a, b).agg(F.sum((~F.col(side)).cast("long")).alias("n_a"), F.sum(F.col(side).cast("long")).alias("n_b"))
    t = n.agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"))
    return n.crossJoin(F.broadcast(t)).agg((F.sum(F.abs(F.col("n_a") / F.col("t_a") - F.col("n_b") / F.col("t_b"))) / 2).alias("error"))


def summarise(metrics: DataFrame, compat_std: bool = False) -> DataFrame:
    """(metric, mean, std) over columns of (metric, column, value). compat_std: the mean counts as one more value."""
    got = metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("s"), F.count("value").alias("n"))
    std = F.sqrt(F.col("s") * F.col("s") * (F.col("n") - 1) / F.col("n")) if compat_std else F.col("s")
    return got.select("metric", "mean", std.alias("std"))


def single_report(df: DataFrame, continuous: list[str], categorical: list[str], side: str = "syn", ks: tuple[int, ...] = (100, 1000), tolerances: tuple[float, ...] = (0.001, 0.01, 0.1, 0.15), digits: int = 3) -> DataFrame:
    """(metric, column, value): all single-column measures."""
    freq = frequencies(df, sorted(continuous + categorical), side)
    long = lambda d, m: d.select(F.lit(m).alias("metric"), "column", F.round(F.col(m), digits).alias("value"))
    gaps, div = distances(freq), divergences(freq)
    parts = [long(gaps, "ks"), long(gaps, "mean_quantile_error"), long(gaps, "emd"), long(div, "jsd"), long(entropy_differences(column_entropies(df, continuous, categorical, side), side), "entropy_error")]
    for k in ks:
        for t in tolerances:
            parts.append(top_recall_error(freq.where(F.col("column").isin(continuous)), k, t).select(F.lit(f"top_{k}_within_{t}").alias("metric"), "column", F.round("recall_error", digits).alias("value")))
        if categorical:
            parts.append(top_recall_error(freq.where(F.col("column").isin(categorical)), k, 0.0).select(F.lit(f"top_{k}_exact").alias("metric"), "column", F.round("recall_error", digits).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def cross_report(df: DataFrame, columns: list[str], side: str = "syn", digits: int = 2) -> DataFrame:
    """(metric, a, b, value): all pair measures."""
    parts = (("cardinality", pair_cardinality(df, columns, side)), ("norm", pair_norms(df, columns, side)), ("pooled_frequency", pooled_frequency_error(frequencies(df, columns, side), columns)))
    out = None
    for name, p in parts:
        one = p.select(F.lit(name).alias("metric"), "a", "b", F.round("error", digits).alias("value"))
        out = one if out is None else out.union(one)
    return out


def weighted_bins_entropy(freq: DataFrame, n: str) -> DataFrame:
    """(column, entropy): of bins whose width is Sturges' bin count or Freedman-Diaconis over distinct values, the variant that sketches are held to."""
    some = freq.where(F.col(n) > 0)
    q = ranges.quantiles(some.select("column", "value", F.lit(1).cast("long").alias("one")), ["column"], "value", "one", [0.25, 0.75])
    stats = some.groupBy("column").agg(F.count("*").cast("double").alias("u"), F.min("value").alias("low")).join(q, "column")
    fd = 2 * (F.col("q")[1] - F.col("q")[0]) / F.pow(F.col("u"), 1 / 3)
    stats = stats.select("column", "low", F.greatest(fd, F.log2("u") + 1).alias("width"))
    binned = some.join(F.broadcast(stats), "column").groupBy("column", F.floor((F.col("value") - F.col("low")) / F.col("width")).alias("b")).agg(F.sum(n).alias("n"))
    return entropy_of(binned)


def rank_counts(freq: DataFrame, n: str) -> DataFrame:
    """(column, value, rows_below): rows with a smaller value."""
    return ranges.running(freq.select("column", "value", n), ["column"], "value", [n]).select("column", "value", (F.col(f"c_{n}") - F.col(n)).cast("long").alias("rows_below"))


def padded_cdf_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (max_gap, mean_gap) of two (i, n) tables' distribution functions at every i of either; before its start one is 0, past its end 1."""
    one = lambda df, x, y: df.select("i", x.alias("n_a"), y.alias("n_b"))
    zero = F.lit(0).cast("long")
    both = one(a, F.col("n"), zero).union(one(b, zero, F.col("n"))).groupBy("i").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    gaps = _cdfs(both.select(F.lit("i").alias("column"), F.col("i").cast("double").alias("value"), "n_a", "n_b"))
    return gaps.agg(F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"))


def histograms(df: DataFrame, column: str, bins: int = 15, side: str = "syn") -> DataFrame:
    """(bin, n_a, n_b) over the range of both sides."""
    from netquill.operators.clean import equal_width

    wide = equal_width(df, column, bins, [side])
    return wide.groupBy("bin").agg(F.sum(F.when(~F.col(side), F.col("count")).otherwise(0)).alias("n_a"), F.sum(F.when(F.col(side), F.col("count")).otherwise(0)).alias("n_b"))


def fourier_draws(columns: int, features: int, width: float = 1.0, seed: int = 7) -> list[tuple[list[float], float]]:
    """Frequencies and phase of each random Fourier feature of the Gaussian kernel."""
    rng = np.random.default_rng(seed)
    return [([float(x) for x in rng.normal(0, 1 / width, columns)], float(rng.uniform(0, 2 * math.pi))) for _ in range(features)]


def mmd(df: DataFrame, columns: list[str], side: str = "syn", features: int = 128, width: float = 1.0, seed: int = 7) -> DataFrame:
    """One row: squared maximum mean discrepancy under a Gaussian kernel, over all rows.

    The kernel is taken by random Fourier features, whose error falls with the
    root of their number: mmd2 = 2 / features * sum of (mean on one side - mean on
    the other)^2, from one aggregate.
    """
    draws = fourier_draws(len(columns), features, width, seed)
    total = lambda ws: reduce(lambda a, b: a + b, [F.col(c).cast("double") * F.lit(w) for c, w in zip(columns, ws)])
    cells = [F.cos(total(ws) + F.lit(o)) for ws, o in draws]
    means = df.groupBy(side).agg(*[F.avg(c).alias(f"f{i}") for i, c in enumerate(cells)])
    pick = lambda i, s: F.max(F.when(F.col(side) == F.lit(s), F.col(f"f{i}")))
    return means.agg((F.lit(2.0 / features) * reduce(lambda a, b: a + b, [F.pow(pick(i, False) - pick(i, True), 2) for i in range(features)])).alias("mmd2"))
