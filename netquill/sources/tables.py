"""Reading and writing tables, reports and parameters."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netquill.operators import clean

MAX_BLOCK = 1_000_000_000


@dataclass(frozen=True)
class Loaded:
    data: DataFrame
    continuous: list[str]
    categorical: list[str]


def read(spark: SparkSession, paths: str | list[str], kind: str = "csv", schema: StructType | str | None = None, encoding: str | None = None, nulls: str = "") -> DataFrame:
    """CSV with a header, or Parquet, from a path, a glob or a list of them.

    Without an encoding, CSV is read as UTF-8, and as Latin-1 if a line of it is
    not UTF-8.
    """
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unknown format: {kind}")
    reader = spark.read.schema(schema) if schema else spark.read
    paths = [paths] if isinstance(paths, str) else list(paths)
    if kind == "parquet":
        return reader.parquet(*paths)
    if encoding is None:
        lines = spark.read.text(paths)
        encoding = "latin1" if lines.where(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"
    options = {"header": True, "encoding": {"latin1": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(encoding.lower(), encoding), "nullValue": nulls, "ignoreLeadingWhiteSpace": True}
    return reader.options(**options, **({} if schema else {"inferSchema": True})).csv(paths)


def read_prepared(spark: SparkSession, paths: str | list[str], kind: str = "csv", excluded: str | list[str] = ("time", "timestamp"), categoricals: str | list[str] = "auto", output: str = "double", **how) -> Loaded:
    """Reads, drops excluded columns, finds roles, then casts the numeric ones."""
    df = clean.exclude(read(spark, paths, kind, **how), list(excluded) if not isinstance(excluded, str) else excluded)
    cats = clean.categorical_columns(df, categoricals)
    cont = [c for c in df.columns if c not in cats]
    return Loaded(df.select(*[F.col(c).try_cast(output).alias(c) if c in cont else F.col(c) for c in df.columns]), cont, cats)


def read_pair(spark: SparkSession, original: str, synthetic: str, kind: str = "csv", excluded: str | list[str] = (), digits: int | None = None) -> DataFrame:
    """Both tables under a column syn: shared columns in name order, exclusions dropped, floats rounded."""
    a, b = read(spark, original, kind), read(spark, synthetic, kind)
    names = clean.shared_columns(a, b)
    pick = lambda df, flag: clean.discretise(clean.exclude(df.select(*names), excluded), digits).withColumn("syn", F.lit(flag))
    return pick(a, False).unionByName(pick(b, True))


def read_sample(spark: SparkSession, path: str, fraction: float, kind: str = "csv", excluded: str | list[str] = (), seed: int = 0) -> Loaded:
    df = clean.exclude(read(spark, path, kind), excluded).sample(fraction=fraction, seed=seed)
    cats = clean.categorical_columns(df)
    return Loaded(df, [c for c in df.columns if c not in cats], cats)


def work_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session may lack it, and uses its warehouse folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that what is used again is not worked out again."""
    path = f"{work_dir(df.sparkSession)}/netquill-io-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def total_bytes(spark: SparkSession, paths: str | list[str]) -> int:
    """By Spark's file index, so any store it reads will do."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("length")
    return int(rows.agg(F.sum("length")).first()[0] or 0)


def block_size(spark: SparkSession, paths: str | list[str], most: int = MAX_BLOCK) -> int:
    """Bytes per core, at most `most`; for spark.sql.files.maxPartitionBytes."""
    return min(most, max(1, -(-total_bytes(spark, paths) // spark.sparkContext.defaultParallelism)))


def write(df: DataFrame, path: str, kind: str = "parquet", single_file: bool = False, header: bool = True, parts: int | None = None) -> None:
    df = df.coalesce(1) if single_file else df.repartition(parts) if parts else df
    writer = df.write.mode("overwrite")
    writer.option("header", header).csv(path) if kind == "csv" else writer.format(kind).save(path)


def save_prepared(prepared, folder: str) -> None:
    """Parquet beside a one-row JSON table of steps and roles, in any store that Spark writes."""
    spark = prepared.data.sparkSession
    prepared.data.write.mode("overwrite").parquet(f"{folder}/data")
    text = json.dumps({"columns": prepared.columns, "continuous": prepared.continuous, "categories": prepared.categories, "steps": [s.to_dict() for s in prepared.steps]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def load_prepared(spark: SparkSession, folder: str):
    from netquill.operators.transforms import Step
    from netquill.plans.transform_plan import Prepared

    d = json.loads(spark.read.text(f"{folder}/meta").first().value)
    return Prepared(spark.read.parquet(f"{folder}/data"), [Step.from_dict(x) for x in d["steps"]], d["columns"], d["continuous"], d["categories"])


def save_report(metrics: DataFrame, folder: str, **about) -> dict:
    """A report's few rows and what they are about, as JSON in any store that Spark writes."""
    out = {"about": about, "rows": [r.asDict(recursive=True) for r in metrics.collect()]}
    spark = metrics.sparkSession
    spark.createDataFrame([(json.dumps(out, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(folder)
    return out


def load_report(spark: SparkSession, folder: str, schema: str | StructType) -> tuple[DataFrame, dict]:
    """A saved report's rows and what they are about."""
    got = json.loads(spark.read.text(folder).first().value)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(r.get(c) for c in kind.names) for r in got["rows"]], kind), got["about"]


def save_settings(settings: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(settings, default=str, indent=1))


def load_settings(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())
