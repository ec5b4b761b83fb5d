"""Grouped top-k questions over ports and protocols, and how two sides' answers agree.

Both sides stand in one table under a boolean column, so each question is one
scan, one aggregation combined before its shuffle, and one ranking that Spark
limits to k rows per side before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_PORT, LOW_PKTS = 1000, 1000


def top(df: DataFrame, keys: Sequence[str], score: Column, k: int, side: str = "syn") -> DataFrame:
    """(side, keys, score, rank): the k greatest of each side, ties by key."""
    totals = df.groupBy(side, *keys).agg(score.alias("score"))
    rank = F.row_number().over(Window.partitionBy(side).orderBy(F.col("score").desc(), *keys))
    return totals.withColumn("rank", rank).where(F.col("rank") <= k)


def busiest_sources(df: DataFrame, k: int = 5000) -> DataFrame:
    """Sources by distinct (destination, protocol)."""
    pairs = df.select("syn", "src", "dst", "proto").distinct()
    return top(pairs, ["src"], F.count("*"), k)


def busiest_destinations(df: DataFrame, k: int = 5000) -> DataFrame:
    """Destinations by distinct (source, protocol)."""
    pairs = df.select("syn", "src", "dst", "proto").distinct()
    return top(pairs, ["dst"], F.count("*"), k)


def heaviest_flows(df: DataFrame, k: int = 5000) -> DataFrame:
    """(src, dst, proto) to low ports by packets, as an integer."""
    low = df.where(F.col("dst") <= LOW_PORT)
    return top(low, ["src", "dst", "proto"], F.sum(F.col("in_pkts") + F.col("out_pkts")).cast("long"), k)


def commonest_protocols(df: DataFrame, k: int = 10) -> DataFrame:
    """Protocols by rows of few packets."""
    few = df.where(F.col("in_pkts") + F.col("out_pkts") <= LOW_PKTS)
    return top(few, ["proto"], F.count("*"), k)


def exact_sum(name: str) -> Column:
    """A sum in decimals of four places, so it does not depend on the order of rows."""
    return F.sum(F.col(name).cast("decimal(18,4)")).cast("double")


def heaviest_receivers(df: DataFrame, k: int = 5000) -> DataFrame:
    """(dst, proto) by bytes out."""
    return top(df, ["dst", "proto"], exact_sum("out_bytes"), k)


QUESTIONS = {
    "busiest_sources": (busiest_sources, ["src"], 5000),
    "heaviest_flows": (heaviest_flows, ["src", "dst", "proto"], 5000),
    "busiest_destinations": (busiest_destinations, ["dst"], 5000),
    "commonest_protocols": (commonest_protocols, ["proto"], 10),
    "heaviest_receivers": (heaviest_receivers, ["dst", "proto"], 5000),
}


def agreement(tops: DataFrame, keys: Sequence[str], side: str = "syn") -> DataFrame:
    """One row: iou, recall and symmetric difference of the two sides' key sets; null where a set is empty."""
    flags = tops.groupBy(*keys).agg(F.max((~F.col(side)).cast("int")).alias("a"), F.max(F.col(side).cast("int")).alias("b"))
    both, first = F.sum(F.col("a") * F.col("b")).cast("double"), F.sum("a").cast("double")
    return flags.agg(F.try_divide(both, F.count("*").cast("double")).alias("iou"), F.try_divide(both, first).alias("recall"), F.coalesce(F.sum((F.col("a") != F.col("b")).cast("int")), F.lit(0)).cast("long").alias("difference"))


def flow_report(df: DataFrame, ks: dict[str, int] | None = None) -> DataFrame:
    """(question, iou, recall, iou_low, recall_low): low keeps keys with a destination of LOW_PORT or less."""
    out = None
    for name, (ask, keys, k) in QUESTIONS.items():
        tops = ask(df, (ks or {}).get(name, k))
        row = agreement(tops, keys).select(F.lit(name).alias("question"), "iou", "recall")
        low = agreement(tops.where(F.col("dst") <= LOW_PORT), keys).select(F.col("iou").alias("iou_low"), F.col("recall").alias("recall_low")) if "dst" in keys else None
        row = row.crossJoin(low) if low is not None else row.withColumn("iou_low", F.lit(None).cast("double")).withColumn("recall_low", F.lit(None).cast("double"))
        out = row if out is None else out.unionByName(row)
    return out


def totals_by(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(key, name), greatest first, ties by key."""
    return df.groupBy(key).agg(value.alias(name)).orderBy(F.col(name).desc(), key)


def bytes_out_by_port(df: DataFrame) -> DataFrame:
    return totals_by(df, "dst", exact_sum("out_bytes"), "bytes_out")


def bytes_in_by_port(df: DataFrame) -> DataFrame:
    return totals_by(df, "src", exact_sum("in_bytes"), "bytes_in")


def rows_by_protocol(df: DataFrame) -> DataFrame:
    return totals_by(df, "proto", F.count("*"), "n_rows")


def flows_by_port(df: DataFrame) -> DataFrame:
    return totals_by(df, "dst", F.count("*"), "n_flows")


def summary(df: DataFrame, n: int = 10) -> DataFrame:
    """(list, key, value, rank): the n first of each of the four totals."""
    out = None
    for name, part in (("bytes_out", bytes_out_by_port(df)), ("bytes_in", bytes_in_by_port(df)), ("protocol_rows", rows_by_protocol(df)), ("port_flows", flows_by_port(df))):
        key, value = part.columns
        one = part.limit(n).select(F.lit(name).alias("list"), F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("value"))
        out = one if out is None else out.union(one)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.col("value").desc(), "key")))
