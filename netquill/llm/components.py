"""Connected components over an edge table, by alternating large and small stars.

DataFrame operations only. Each half step is one keyed minimum, which Spark
combines before its shuffle, and one join against that written minimum table,
so a hub with very many neighbours is split by AQE and not held in one task.
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import stash


def _star(edges: DataFrame, name: str, both_ways: bool) -> DataFrame:
    """edges (u, v) with u > v. Large star looks both ways, small star only down."""
    pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    low = stash(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}_min")
    joined = pairs.join(low, "u")
    if both_ways:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return stash(out.where("u <> v").distinct(), name)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Self-loops, repeated edges and both directions are allowed; rows with a null
    end are left out. An empty edge table gives an empty result.
    """
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    loops = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stash(loops, "edges")
    alone = now.where("u = v").select("u")
    now = now.where("u <> v")
    before = _mark(now)
    for k in range(max_rounds if before[0] else 0):
        now = _star(_star(now, f"large{k}", True), f"small{k}", False)
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).union(alone.join(now, "u", "left_anti").select("u")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component"))).dropDuplicates(["node"])
