"""Sharding by longest processing time.

Groups of equal texts must stay together. Groups above 1 / (1000 * shards) of
all bytes, of which there are fewer than 1000 * shards, stand alone; the others
are bundled by hash into BUNDLES parts. So at most 1000 * shards + BUNDLES items,
whatever the input's size, go through the heap on the driver, largest first,
each to the least-loaded shard.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.llm.common import row_of, stash

BUNDLES = 16384
#: Parts of a shard within which slots are numbered by one task each.
SLOT_PARTS = 1024


def lpt(sizes: list[tuple[int, object]], shards: int) -> dict:
    """key -> shard for (size, key) items; ties go by key, then by the lower shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, s = heap[0]
        out[key] = s
        heapq.heapreplace(heap, (load + size, s))
    return out


def group_key(text: Column) -> list[Column]:
    """Equal for equal texts; texts that merely collide would only be kept together."""
    return [F.xxhash64(text).alias("k1"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("k2"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size")]


def _with_shard(rows: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """rows and groups have k1, k2 and size; groups also has the group's bytes."""
    spark = rows.sparkSession
    bundle = F.pmod(F.xxhash64("k1", "k2"), F.lit(BUNDLES)).cast("int")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone = F.col("bytes") > F.lit(total // (1000 * shards))
    item = groups.select(F.when(alone, F.lit(-1)).otherwise(bundle).alias("b"), F.when(alone, F.col("k1")).alias("k1"), F.when(alone, F.col("k2")).alias("k2"), F.when(alone, F.col("size")).alias("size"), "bytes")
    items = item.groupBy("b", "k1", "k2", "size").agg(F.sum("bytes").alias("bytes")).collect()  # at most 1000 * shards + BUNDLES rows
    to = lpt([(r.bytes, (r.b, r.k1 or 0, r.k2 or 0, r.size or 0)) for r in items], shards)
    large = pd.DataFrame([(k[1], k[2], k[3], s) for k, s in to.items() if k[0] < 0], columns=["k1", "k2", "size", "s1"], dtype="int64")
    small = pd.DataFrame([(k[0], s) for k, s in to.items() if k[0] >= 0], columns=["b", "s2"], dtype="int64")
    large = spark.createDataFrame(large, "k1 long, k2 long, size long, s1 int")
    small = spark.createDataFrame(small, "b int, s2 int")
    got = rows.join(F.broadcast(large), ["k1", "k2", "size"], "left").withColumn("b", bundle).join(F.broadcast(small), "b", "left")
    return got.withColumn("shard", F.coalesce("s1", "s2")).drop("b", "s1", "s2")


def shard_plan(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of docs.

    size is the text's UTF-8 bytes plus 1; a null text has none, CRC 0, and nulls
    form one group. Rows with equal texts, repeated rows too, share a shard, and
    texts count by their whole length; ties of size go by the text's hashes. Slots
    of a shard run from 0 without gaps, in an order fixed by id and text. Null
    ids are allowed. Other columns are left out. An empty table gives an empty
    result.
    """
    rows = stash(docs.select(F.col(id_col).alias("id"), *group_key(F.col(text_col))), "sizes")
    groups = rows.groupBy("k1", "k2", "size").agg(F.sum("size").alias("bytes"))
    part = F.pmod(F.xxhash64("id", "k1", "k2"), F.lit(SLOT_PARTS)).cast("int")
    got = _with_shard(rows, groups, shards).withColumn("part", part)
    counts = got.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most shards * SLOT_PARTS rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "k1", "k2")) - 1
    out = got.withColumn("own", own).join(F.broadcast(offsets), ["shard", "part"])
    return out.select("id", "size", F.col("k2").alias("text_crc32"), "shard", (F.col("at") + F.col("own")).cast("long").alias("slot"))


def with_shards(docs: DataFrame, shards: int = 16, text_col: str = "text", name: str = "shard") -> DataFrame:
    """docs and the column name with each row's shard; a column that already has this name is replaced.

    Rows with equal texts, repeated rows too, share a shard; null texts form one
    group, and an empty text another. Texts count by their whole length, and ties
    of size go by the text's hashes, so reruns agree. Null ids and further
    columns, whatever their names, come back unchanged. An empty table gives an
    empty result.
    """
    rows = docs.select(row_of(docs), *group_key(F.col(text_col)))
    groups = stash(rows.groupBy("k1", "k2", "size").agg(F.sum("size").alias("bytes")), "groups")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != name.lower()]
    return _with_shard(rows, groups, shards).select(*kept, F.col("shard").alias(name))
