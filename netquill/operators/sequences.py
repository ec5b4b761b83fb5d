"""Fixed-length windows and batches over ordered rows.

Rows get a global index without a global sort in one task: ranges between
approximate quantiles, counts per range, and offsets. A window of L rows then needs L - 1 rows from
the next block, which are copied to it (a halo), so blocks are windowed apart.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 16


def _ordinal(df: DataFrame, order: str) -> Column:
    kind = df.schema[order].dataType
    return F.unix_micros(F.col(order).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(order)


def indexed(df: DataFrame, order: str, name: str = "row_index", parts: int = 64) -> DataFrame:
    """df with the 0-based position of each row in the given order (unique numbers or times, without nulls)."""
    key = _ordinal(df, order)
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000).alias("c")).first().c or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("nq_key"))) if cuts else F.lit(0)
    dealt = df.withColumn("nq_key", key).withColumn("nq_part", part)
    counts = dealt.groupBy("nq_part").agg(F.count("*").alias("n"))
    offsets = counts.select(F.col("nq_part"), F.coalesce(F.sum("n").over(Window.orderBy("nq_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("nq_at"))
    own = F.row_number().over(Window.partitionBy("nq_part").orderBy("nq_key")) - 1
    return dealt.withColumn("nq_own", own).join(F.broadcast(offsets), "nq_part").withColumn(name, (F.col("nq_at") + F.col("nq_own")).cast("long")).drop("nq_key", "nq_part", "nq_own", "nq_at")


def sliding_windows(df: DataFrame, order: str, columns: list[str], length: int, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """(window_id, rows array<array<double>>): full windows only, each once; window i starts at row i * stride."""
    if length > block:
        raise ValueError("a window must fit a block")
    rows = indexed(df.select(order, *columns), order).select("row_index", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    own = F.floor(F.col("row_index") / block)
    halo = (F.col("row_index") % block < length - 1) & (own > 0)
    dealt = rows.select("*", F.explode(F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))).alias("b"))
    w = Window.partitionBy("b").orderBy("row_index").rowsBetween(0, length - 1)
    got = dealt.select("b", "row_index", F.collect_list("x").over(w).alias("rows"))
    full = (F.size("rows") == length) & (F.col("row_index") % stride == 0) & (F.floor(F.col("row_index") / block) == F.col("b"))
    return got.where(full).select((F.col("row_index") / stride).cast("long").alias("window_id"), "rows")


def batches(df: DataFrame, order: str, size: int, keep_last: bool = True) -> DataFrame:
    """df with batch_id; the last, shorter batch stays unless keep_last is false."""
    got = indexed(df, order).withColumn("batch_id", F.floor(F.col("row_index") / size).cast("long"))
    if keep_last:
        return got.drop("row_index")
    last = got.agg((F.max("row_index") + 1).alias("n"))
    return got.crossJoin(F.broadcast(last)).where((F.col("batch_id") + 1) * size <= F.col("n")).drop("n", "row_index")


def window_batches(windows: DataFrame, size: int) -> DataFrame:
    """Windows with the id of the batch that they go into."""
    return windows.withColumn("batch_id", F.floor(F.col("window_id") / size).cast("long"))


def iterate(df: DataFrame, columns: list[str] | None = None) -> Iterator:
    """Rows to the driver, one partition ahead of the reader."""
    return (df.select(*columns) if columns else df).toLocalIterator(prefetchPartitions=True)


def worker_split(df: DataFrame, rank: int, workers: int, key: str) -> DataFrame:
    """The rows of one of several workers, by hash of a key; together they are all rows."""
    return df.where(F.floor(hash_fraction(F.col(key)) * workers) == rank)


def hash_fraction(c: Column, seed: str = "") -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), c.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample_rows(df: DataFrame, fraction: float, key: str | None = None, seed: int = 0) -> DataFrame:
    """A random share of rows; by key, the same rows at any partitioning."""
    return df.where(hash_fraction(F.col(key), str(seed)) < fraction) if key else df.sample(fraction=fraction, seed=seed)


def capped_sample(df: DataFrame, fraction: float = 0.1, rows: int = 50_000, seed: int = 0, key: Column | None = None) -> DataFrame:
    """A random share of rows, at most rows of them, drawn alike from all partitions: those of least hash of the key, or of least random number."""
    u = hash_fraction(key, str(seed)) if key is not None else F.rand(seed)
    return df.withColumn("nq_u", u).where(F.col("nq_u") < fraction).orderBy("nq_u").limit(rows).drop("nq_u")


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by hash of a key."""
    u = hash_fraction(F.col(key), str(seed))
    return df.where(u < share), df.where(u >= share)
