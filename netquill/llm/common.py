"""What the operators share: written intermediate tables, word patterns, hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.sources.tables import work_dir

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Folders of stash(), in order.
_MADE: list[str] = []
#: Values that running() combines in one piece.
RUN_BLOCK = 256
#: Rows of two or three longs that may go to every executor at once, some 40 MB.
SMALL_ROWS = 1_000_000


def stash(df: DataFrame, name: str, compression: str = "snappy", split: str | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder, in a folder for each value of split, and reads it back.

    The files outlive any executor. They go when drop_stash() or forget() is told
    so, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = _new_folder(spark, name)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(split) if split else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _new_folder(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/netquill/{uuid.uuid4().hex}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    _MADE.append(where.getParent().toString())
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where.getParent())
    return path


def forget(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Removes the folders that stash() has made since it had made so many, but for that of keep."""
    kept = {f.rsplit("/", 2)[0] for f in keep.inputFiles()}
    for folder in _MADE[since:]:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not any(folder.rstrip("/").rsplit("/", 1)[1] in k for k in kept):
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    release(spark)


def drop_stash(df: DataFrame) -> None:
    """Removes the files of a stashed table that nothing reads any more, and lets go of shuffles without readers."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        if "/netquill/" in folder:
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    release(spark)


def made() -> int:
    """How many tables have been stashed so far."""
    return len(_MADE)


def release(spark: SparkSession) -> None:
    """Spark removes a shuffle's files once the driver has collected the plan that wrote them."""
    for _ in range(2):  # Python's references to the plan go first
        gc.collect()
        spark._jvm.System.gc()


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, so that further columns can have any name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def matched(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """left_semi or left_anti join by a written table of distinct long columns.

    Up to SMALL_ROWS keys, counted here, go to every executor and the rows stay
    where they are; more are met by a merge join, which moves the rows.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys.hint("merge"), on, how)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; lower() does that fast where there are only ASCII bytes."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where lambdas in body use it again and again."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1; empty if n is under 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each value combined with all before it; an array grows by RUN_BLOCK at most in one piece, as growing copies it."""
    step = lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(combine(F.element_at(acc, F.size(acc)), x)))
    grown = lambda v: F.aggregate(v, F.array().cast("array<int>"), step)

    def joined(blocks: Column) -> Column:
        ends = grown(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: combine(F.get(e, i - 1), x))))))

    cut = lambda v: F.transform(upto(F.ceil(F.size(v) / RUN_BLOCK)), lambda i: grown(F.slice(v, i * RUN_BLOCK + 1, RUN_BLOCK)))
    return let(values, lambda v: F.when(F.size(v) <= RUN_BLOCK, grown(v)).otherwise(let(cut(v), joined)))


def words_of(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
