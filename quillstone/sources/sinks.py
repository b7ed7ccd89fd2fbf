"""Sinks: split fan-out, CSV, staged publishing, indices, reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.joins import readback_diff


def write_jsonl(rows: DataFrame, path: str, nulls: bool = True, mode: str = "errorifexists") -> None:
    """One JSON object a line, text unescaped; nulls are written unless told otherwise."""
    rows.write.mode(mode).option("ignoreNullFields", not nulls).json(path)


def write_splits(rows: DataFrame, path: str, key: str = "sample_id", files: int | None = None) -> None:
    """A folder for each split, rows ordered by key; large splits are cut by range of the key."""
    n = files or rows.sparkSession.sparkContext.defaultParallelism
    rows.repartitionByRange(n, "split", key).sortWithinPartitions("split", key).write.mode("errorifexists").partitionBy("split").json(path)


def write_csv(summary: DataFrame, path: str) -> None:
    """A small summary as one CSV file with a header."""
    summary.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_once(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file, or leave the old one: a file beside it is synced and takes its name. Any file system that Spark reaches."""
    fs, target = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(data))
    out.hsync()
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(beside, target, options)


def publish(parts: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Write all parts, or none: into a staging folder that is renamed last. An existing target raises.

    Paths may be of any file system that Spark reaches.
    """
    spark = next(iter(parts.values())).sparkSession
    fs, target = _fs(spark, path)
    staging = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".staging")
    if fs.exists(target):
        raise FileExistsError(path)
    fs.delete(staging, True)
    try:
        for name, df in parts.items():
            df.write.format(kind).save(f"{path.rstrip('/')}.staging/{name}")
        if not fs.rename(staging, target):
            raise OSError(f"could not rename to {path}")
    finally:
        fs.delete(staging, True)


def directory_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, sha256, bytes) of all files under a folder, names relative to it."""
    base = _fs(spark, path)[0].makeQualified(_fs(spark, path)[1]).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", base, -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def copy_problems(spark: SparkSession, source: str, copy: str) -> DataFrame:
    """Rows (name, problem) where a copied folder differs from its source."""
    return readback_diff(directory_index(spark, source), directory_index(spark, copy), "name", ["sha256", "bytes"])


def cached(spark: SparkSession, path: str, config_sha: str, seed: int, build) -> DataFrame:
    """The rows of `build()`, kept under a key of configuration and seed and read from there again."""
    at = f"{path.rstrip('/')}/config={config_sha}/seed={seed}"
    fs, target = _fs(spark, at)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
        fs.delete(target, True)
        build().write.parquet(at)
    return spark.read.parquet(at)


def markdown(summary: DataFrame, title: str, order: Sequence[str]) -> str:
    """A small summary as a Markdown table."""
    rows = summary.orderBy(*order).collect()
    show = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    body = ["| " + " | ".join(show(x) for x in r) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + " --- |" * len(summary.columns), *body, ""])
