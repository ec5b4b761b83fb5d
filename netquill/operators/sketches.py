"""Mergeable frequency sketches as tables of cells.

A sketch is (column, level, row, bucket, cell). Values are counted first, so
hashing costs one step per distinct value; merging two sketches is a union and a
sum. Buckets and signs come from MD5, which any engine can recompute. Noise for
differential privacy is added once, after all merging.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.operators import ranges
from netquill.operators.clean import melt


def hashed(value: Column, salt: Column, start: int = 1) -> Column:
    """8 hex digits of MD5(value, salt) as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", value, salt.cast("string")).cast("binary")), start, 8), 16, 10).cast("long")


def _cells(values: DataFrame, rows: int, width: int, keys: list[str]) -> DataFrame:
    """values: (keys, value string, n)."""
    each = values.select(*keys, "n", "value", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    sign = 1 - 2 * F.pmod(hashed(F.col("value"), F.col("row"), 9), F.lit(2))
    return each.select(*keys, "row", "value", "n", F.pmod(hashed(F.col("value"), F.col("row")), F.lit(width)).alias("bucket"), sign.alias("sign"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return melt(df, columns).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def count_sketch(counts: DataFrame, rows: int = 10, width: int = 2000, keys: tuple[str, ...] = ("column",)) -> DataFrame:
    """(keys, row, bucket, cell) from (keys, value, n)."""
    return _cells(counts, rows, width, list(keys)).groupBy(*keys, "row", "bucket").agg(F.sum(F.col("sign") * F.col("n")).alias("cell"))


def merge(*sketches: DataFrame) -> DataFrame:
    keys = [c for c in sketches[0].columns if c != "cell"]
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*keys).agg(F.sum("cell").alias("cell"))


def estimates(sketch: DataFrame, domain: DataFrame, rows: int = 10, width: int = 2000, keys: tuple[str, ...] = ("column",)) -> DataFrame:
    """(keys, value, estimate): the median over rows of sign times cell, 0 where a cell is empty."""
    asked = _cells(domain.select(*keys, "value", F.lit(0).alias("n")), rows, width, list(keys)).drop("n")
    found = asked.join(sketch, [*keys, "row", "bucket"], "left")
    return found.groupBy(*keys, "value").agg(F.median(F.col("sign") * F.coalesce("cell", F.lit(0))).alias("estimate"))


def noise_scale(rho: float, rows: int) -> float:
    """Deviation of the cells' noise under rho-zCDP, with failure probability exp(-rows)."""
    return math.sqrt(math.log(2 / math.exp(-rows)) / rho)


def with_noise(sketch: DataFrame, rho: float, rows: int = 10, width: int = 2000, keys: tuple[str, ...] = ("column",), seed: str = "noise") -> DataFrame:
    """Every cell, empty ones too, with Gaussian noise; once, on the merged sketch. A cell's noise comes from the seed and its key, whatever the partitioning; keep the seed secret."""
    spark = sketch.sparkSession
    cells = spark.range(rows * width).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).alias("bucket"))
    grid = sketch.select(*keys).distinct().crossJoin(F.broadcast(cells))  # a table of fixed size
    name = F.concat_ws("|", *keys, "row", "bucket")
    u = [(hashed(name, F.lit(seed), at) + 0.5) / F.lit(4294967296.0) for at in (1, 9)]
    normal = F.sqrt(-2 * F.log(u[0])) * F.cos(F.lit(2 * math.pi) * u[1])
    return grid.join(sketch, [*keys, "row", "bucket"], "left").select(*keys, "row", "bucket", (F.coalesce("cell", F.lit(0)) + normal * noise_scale(rho, rows)).alias("cell"))


def top_k(est: DataFrame, k: int) -> DataFrame:
    """(column, value, estimate, rank) by absolute estimate, ties by value."""
    size = F.abs("estimate")
    return est.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(size.desc(), "value"))).where(F.col("rank") <= k)


def entropy(est: DataFrame) -> DataFrame:
    """(column, entropy) in nats, of absolute estimates."""
    size = F.abs("estimate")
    p = size / F.sum(size).over(Window.partitionBy("column"))
    return est.where("estimate <> 0").select("column", p.alias("p")).groupBy("column").agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


# Dyadic ---------------------------------------------------------------------


def dyadic_shape(universe: int, gamma: float) -> tuple[int, int, int]:
    """(levels, rows, width)."""
    ln = math.log(universe)
    return math.ceil(math.log2(universe)), 2, math.ceil(1 / gamma * math.sqrt(ln * math.log(ln / gamma)))


def memory_budget(universe: int, gamma: float, cell_bytes: int = 8) -> int:
    levels, rows, width = dyadic_shape(universe, gamma)
    return levels * rows * width * cell_bytes


def dyadic_sketch(counts: DataFrame, universe: int, gamma: float) -> DataFrame:
    """(column, level, row, bucket, cell) of integer values under universe: a Count Sketch of value >> level for each level."""
    levels, rows, width = dyadic_shape(universe, gamma)
    nodes = counts.select("column", "n", F.col("value").cast("long").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    nodes = nodes.groupBy("column", "level", F.expr("shiftright(v, level)").alias("node")).agg(F.sum("n").alias("n"))
    return count_sketch(nodes.select("column", "level", F.concat_ws(":", "level", "node").alias("value"), "n"), rows, width, ("column", "level"))


def dyadic_rank(sketch: DataFrame, queries: DataFrame, universe: int, gamma: float) -> DataFrame:
    """(column, x, rank): estimated rows below x. For each set bit of x, the node just left of its prefix."""
    levels, rows, width = dyadic_shape(universe, gamma)
    parts = queries.select("column", "x", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")).where("shiftright(x, level) & 1 = 1")
    parts = parts.select("column", "x", "level", F.concat_ws(":", "level", F.expr("shiftright(x, level) - 1")).alias("value"))
    est = estimates(sketch, parts.select("column", "level", "value").distinct(), rows, width, ("column", "level"))
    total = parts.join(est, ["column", "level", "value"]).groupBy("column", "x").agg(F.sum("estimate").alias("rank"))
    return queries.join(total, ["column", "x"], "left").select("column", "x", F.coalesce("rank", F.lit(0.0)).alias("rank"))


# UnivMon --------------------------------------------------------------------


def univmon_shape(memory: int, levels: int, rows: int) -> int:
    return max(32, memory // levels // (rows * 4))


def _depth(value: Column, levels: int) -> Column:
    """How many of the seeded hash bits in a row are 1, from the first."""
    bits = F.array(*[F.pmod(hashed(value, F.lit(f"sample{i}")), F.lit(2)) for i in range(levels - 1)])
    first_zero = F.array_position(bits, F.lit(0).cast("long"))
    return F.when(first_zero == 0, F.lit(levels - 1)).otherwise(first_zero - 1).cast("int")


def univmon_levels(counts: DataFrame, levels: int) -> DataFrame:
    """(column, level, value, n, bit): the value in each level it is sampled to; bit: whether it goes on."""
    deep = counts.withColumn("depth", _depth(F.col("value"), levels))
    each = deep.select("column", "value", "n", "depth", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"))
    return each.select("column", "level", "value", "n", (F.col("depth") > F.col("level")).cast("int").alias("bit"))


def univmon(counts: DataFrame, memory: int = 1 << 20, levels: int = 12, rows: int = 5) -> DataFrame:
    return count_sketch(univmon_levels(counts, levels).select("column", "level", "value", "n"), rows, univmon_shape(memory, levels, rows), ("column", "level"))


def univmon_heavy(sketch: DataFrame, domain: DataFrame, k: int = 1000, memory: int = 1 << 20, levels: int = 12, rows: int = 5) -> DataFrame:
    """(column, level, value, bit, estimate): each level's k greatest estimates above 0, as integers."""
    width = univmon_shape(memory, levels, rows)
    asked = univmon_levels(domain.withColumn("n", F.lit(0)), levels)
    est = estimates(sketch, asked.select("column", "level", "value"), rows, width, ("column", "level")).withColumn("estimate", F.floor("estimate"))
    best = est.where("estimate > 0").withColumn("rank", F.row_number().over(Window.partitionBy("column", "level").orderBy(F.col("estimate").desc(), "value"))).where(F.col("rank") <= k)
    return best.join(asked.select("column", "level", "value", "bit"), ["column", "level", "value"]).select("column", "level", "value", "bit", "estimate")


def g_sum(heavy: DataFrame, g: Column, levels: int = 12) -> DataFrame:
    """(column, total): the recursion Y_i = 2 Y_(i+1) + sum of (1 - 2 bit) g, summed up as 2**i times each level's term."""
    term = F.when(F.col("level") == levels - 1, g).otherwise((1 - 2 * F.col("bit")) * g)
    return heavy.groupBy("column").agg(F.sum(F.pow(F.lit(2.0), F.col("level")) * term).alias("total"))


def univmon_cardinality(heavy: DataFrame, levels: int = 12) -> DataFrame:
    return g_sum(heavy, F.lit(1.0), levels).select("column", F.greatest("total", F.lit(0.0)).alias("cardinality"))


def univmon_entropy(heavy: DataFrame, rows_in: DataFrame, levels: int = 12, base: float = 2.0) -> DataFrame:
    """rows_in: (column, n) number of rows. log(n) - G/n with g = x log x."""
    x = F.col("estimate").cast("double")
    g = g_sum(heavy, x * F.log(x) / math.log(base), levels)
    return g.join(rows_in, "column").select("column", (F.log(F.col("n").cast("double")) / math.log(base) - F.col("total") / F.col("n")).alias("entropy"))


def univmon_heavy_hitters(heavy: DataFrame, threshold: float) -> DataFrame:
    return heavy.groupBy("column", "value").agg(F.max("estimate").alias("estimate")).where(F.col("estimate") >= threshold)


# Against exact answers ------------------------------------------------------


def compare_top_k(est: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(column, recall): share of the k commonest values that are among the k greatest estimates."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    exact = counts.withColumn("rank", rank).where(F.col("rank") <= k).select("column", "value")
    got = top_k(est, k).select("column", "value", F.lit(1.0).alias("hit"))
    return exact.join(got, ["column", "value"], "left").groupBy("column").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def compare_entropies(est: DataFrame, counts: DataFrame) -> DataFrame:
    """(column, exact, estimate, error): entropies in nats, and their difference as a share of the exact one."""
    x = F.col("n").cast("double")
    own = counts.where("n > 0").groupBy("column").agg((F.log(F.sum(x)) - F.sum(x * F.log(x)) / F.sum(x)).alias("exact"))
    both = own.join(entropy(est).withColumnRenamed("entropy", "estimate"), "column")
    return both.withColumn("error", F.try_divide(F.abs(F.col("estimate") - F.col("exact")), F.col("exact")))


def compare_ranks(ranks: DataFrame, counts: DataFrame) -> DataFrame:
    """(column, mean_error, max_error): of estimated ranks (column, x, rank), as a share of the column's rows. counts: (column, value number, n)."""
    asked = ranks.select("column", F.col("x").cast("double").alias("value"), F.col("rank").alias("asked"), F.lit(0).cast("long").alias("n"))
    both = counts.select("column", F.col("value").cast("double").alias("value"), F.lit(None).cast("double").alias("asked"), "n").union(asked)
    each = both.groupBy("column", "value").agg(F.max("asked").alias("asked"), F.sum("n").alias("n"))
    run = ranges.running(each, ["column"], "value", ["n"]).where("asked is not null")
    gap = F.abs(F.col("asked") - (F.col("c_n") - F.col("n"))) / F.col("t_n")
    return run.groupBy("column").agg(F.avg(gap).alias("mean_error"), F.max(gap).alias("max_error"))
