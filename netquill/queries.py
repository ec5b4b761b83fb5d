"""Registry of queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as flow records; odd orders are the synthetic side."""
    t = load(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("proto"),
        F.col("l_extendedprice").alias("in_bytes"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("out_bytes"),
        F.col("l_quantity").alias("in_pkts"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("out_pkts"),
        F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        (F.col("l_orderkey") % 2 == 1).alias("syn"), F.col("l_orderkey").alias("orderkey"),
    )


FLOWS = """f AS (SELECT l_suppkey AS src, l_partkey AS dst, l_linenumber AS proto, l_extendedprice AS in_bytes,
 l_extendedprice * (1 - l_discount) AS out_bytes, l_quantity AS in_pkts, floor(l_extendedprice / l_quantity) AS out_pkts,
 l_tax AS tax, l_discount AS discount, l_returnflag AS flag, l_linestatus AS status, l_orderkey % 2 = 1 AS syn, l_orderkey AS orderkey FROM lineitem)"""
