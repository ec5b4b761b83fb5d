"""Cleaning, roles and per-column facts of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def drop_non_finite(df: DataFrame) -> DataFrame:
    """Rows without nulls, NaN and infinities."""
    bad = lambda c: F.isnan(c) | c.isin(float("inf"), float("-inf"))
    floats = set(float_columns(df))
    return df.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]).na.drop("any")


def exclude(df: DataFrame, names: str | list[str] | None) -> DataFrame:
    """Without the named columns (a list, or names between blanks); unknown names do nothing."""
    return df.drop(*((names.split() if isinstance(names, str) else names) or []))


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """In name order, so results do not depend on chance."""
    return sorted(set(a.columns) & set(b.columns))


def to_type(df: DataFrame, kind: str = "double", keep: list[str] = ()) -> DataFrame:
    """Every column cast, but for keep; what cannot be cast becomes null."""
    return df.select(*[F.col(c) if c in keep else F.col(c).try_cast(kind).alias(c) for c in df.columns])


def discretise(df: DataFrame, digits: int | None, columns: list[str] | None = None) -> DataFrame:
    """Floating-point columns rounded half to even."""
    if digits is None:
        return df
    targets = set(columns if columns is not None else float_columns(df))
    return df.select(*[F.bround(c, digits).alias(c) if c in targets else F.col(c) for c in df.columns])


def with_total(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(a) + F.col(b))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, n_distinct): all columns in one pass over (column, value) pairs, so no rows are expanded per distinct aggregate."""
    columns = columns or df.columns
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_distinct")) for c in columns])).alias("x")).select("x.*")
    pairs = melt(df, columns).where("value is not null").distinct()
    found = pairs.groupBy("column").agg(F.count("*").alias("n_distinct"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def categorical_columns(df: DataFrame, mode: str | list[str] = "auto", at_most: int = 10) -> list[str]:
    """mode "auto" (or ["auto"]): columns of at_most distinct values or fewer; else the given names."""
    if mode in ("auto", ["auto"]):
        return sorted(r.column for r in distinct_counts(df).where(F.col("n_distinct") <= at_most).collect())
    return sorted(mode or [])


def melt(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, column, value string): one row for each cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.column", "x.value")


def melt_numbers(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, column, value double)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.column", "x.value")


def is_datetime(c: Column) -> Column:
    """A date or time of day; names of weekdays and months alone do not count."""
    names = "(?i)^(mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*$"
    return ~c.rlike(names) & F.try_to_timestamp(c).isNotNull()


def is_ssn(c: Column) -> Column:
    """A number above 0 and under 10^9 once dashes are gone."""
    n = F.regexp_replace(c, "-", "").try_cast("bigint")
    return F.coalesce((n > 0) & (n < 1_000_000_000), F.lit(False))


def infer_types(df: DataFrame) -> DataFrame:
    """(column, type): Integer, Float, DateTime, SocialSecurityNumber or String, judged by every value."""
    checks = []
    for f in df.schema.fields:
        c, s = F.col(f"`{f.name}`"), F.col(f"`{f.name}`").cast("string")
        if isinstance(f.dataType, T.BooleanType):
            kind = F.lit("String")
        elif isinstance(f.dataType, NUMERIC):
            kind = F.when(F.coalesce(F.every(c == F.floor(c)), F.lit(True)), "Integer").otherwise("Float")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kind = F.max(F.lit("DateTime"))
        else:
            kind = F.when(F.coalesce(F.every(is_datetime(s)), F.lit(False)), "DateTime").when(F.coalesce(F.every(is_ssn(s)), F.lit(False)), "SocialSecurityNumber").otherwise("String")
        checks.append(kind.alias(f.name))
    row = df.agg(*checks)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("type")) for c in df.columns])).alias("x")).select("x.*")


def column_facts(df: DataFrame, categorical_at_most: int = 20) -> DataFrame:
    """(column, n_rows, n_distinct, missing_rate, is_candidate_key, is_categorical) in two aggregations."""
    n = df.agg(F.count("*").alias("n_rows"), *[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns])
    missing = n.select("n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_rate")) for c in df.columns])).alias("x")).select("n_rows", "x.*")
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DateType, T.TimestampType))]
    key = (F.col("n_distinct") == F.col("n_rows")) & (F.col("n_rows") > 0) & ~F.col("column").isin(floating or [""])
    return missing.join(distinct_counts(df), "column").select("column", "n_rows", "n_distinct", "missing_rate", key.alias("is_candidate_key"), (F.col("n_distinct") <= categorical_at_most).alias("is_categorical"))


def domains(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, high) of numbers, of string lengths, of epoch seconds."""
    def number(name: str) -> Column:
        kind = df.schema[name].dataType
        c = F.col(f"`{name}`")
        if isinstance(kind, T.StringType):
            return F.length(c).cast("double")
        return F.unix_timestamp(c.cast("timestamp")).cast("double") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else c.cast("double")

    row = df.agg(*[f(number(c)).alias(f"{c}|{k}") for c in columns for k, f in (("low", F.min), ("high", F.max))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}|low`").alias("low"), F.col(f"`{c}|high`").alias("high")) for c in columns])).alias("x")).select("x.*")


def equal_width(df: DataFrame, column: str, bins: int, keys: list[str] = (), low: Column | None = None, high: Column | None = None) -> DataFrame:
    """(keys, bin, count): bins of equal width over [min, max]; the last one holds the maximum."""
    edges = df.where(F.col(column).isNotNull()).agg(F.min(column).cast("double").alias("nq_lo"), F.max(column).cast("double").alias("nq_hi"))
    x = F.col(column).cast("double")
    at = F.when(F.col("nq_hi") > F.col("nq_lo"), F.least(F.floor((x - F.col("nq_lo")) / (F.col("nq_hi") - F.col("nq_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
