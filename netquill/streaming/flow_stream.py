"""The flow questions and sketches over unbounded input, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.operators import sketches


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str | None = None, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, keys, n, total): rows and sum of value in each window; rows later than the watermark are dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), *keys, "n", *(["total"] if value else []))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, stop, key, n): activity of a key without a pause of gap."""
    got = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def sketch_sink(columns: list[str], table: str, rows: int = 10, width: int = 2000) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's Count Sketch goes into its own partition, so a batch that runs again replaces itself; merge() adds them up."""

    def write(batch: DataFrame, number: int) -> None:
        cells = sketches.count_sketch(sketches.value_counts(batch, columns), rows, width)
        cells.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return write


def merged_sketch(spark: SparkSession, table: str) -> DataFrame:
    return sketches.merge(spark.read.parquet(table).drop("batch"))


def run_to_end(result: DataFrame, folder: str) -> DataFrame:
    """All that is there now, appended to Parquet in folder; a window or session is written once the watermark has passed it.

    The checkpoint lies beside the data, so a run that was stopped goes on where it
    was, and each result is written once.
    """
    q = result.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/data")


def close(last: DataFrame, folder: str, time: str, after: str = "1000 days") -> None:
    """Ends a finite stream: one more row, long after the last of a batch, moves the watermark past all others. Its own window stays open."""
    end = last.agg(F.max(time).alias("nq_end"))
    row = end.select(*[(F.col("nq_end") + F.expr(f"INTERVAL {after}")).alias(c) if c == time else F.lit(None).cast(last.schema[c].dataType).alias(c) for c in last.columns])
    row.coalesce(1).write.mode("append").parquet(folder)
