"""Append-only logs: prefix resume, isolated failures, and Structured Streaming over files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions.maths import finite


class ResumeError(ValueError):
    """What is done is not a prefix of what is to be done."""


def prefix_problems(wanted: DataFrame, done: DataFrame, key: str, line: str = "_line") -> DataFrame:
    """Rows (line, problem): done rows whose key is not the wanted one of their line, and lines done twice."""
    w = wanted.select(F.col(line).alias("_w"), F.col(key).alias("_k"))
    wrong = done.join(w, F.col(line) == F.col("_w"), "left").where(F.col("_w").isNull() | ~F.col(key).eqNullSafe(F.col("_k")))
    twice = done.groupBy(line).agg(F.count("*").alias("n")).where("n > 1")
    return wrong.select(line, F.lit("not_the_wanted_row").alias("problem")).unionByName(twice.select(line, F.lit("done_twice").alias("problem")))


def remaining(wanted: DataFrame, done: DataFrame, key: str, line: str = "_line") -> DataFrame:
    """The wanted rows that are not done; raises unless the done ones are their first lines."""
    if not prefix_problems(wanted, done, key, line).isEmpty():
        raise ResumeError("done rows differ from the wanted ones")
    n, last = done.agg(F.count("*"), F.coalesce(F.max(line), F.lit(0))).first()
    if n != last:
        raise ResumeError(f"{n} rows are done, up to line {last}")
    return wanted.where(F.col(line) > last)


def cache_problems(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Problems of a log-prob cache against its pairs: those of the prefix, and values that aren't finite."""
    ok = finite(F.col("ref_chosen_logp")) & finite(F.col("ref_rejected_logp"))
    bad = cache.where(~F.coalesce(ok, F.lit(False))).select("_line", F.lit("not_finite").alias("problem"))
    return prefix_problems(pairs, cache, "pair_id").unionByName(bad)


def isolate(rows: DataFrame, key: str, column: str, work: Callable[[str], str]) -> DataFrame:
    """(key, result, error, error_type): `work` on each value; a failure is that row's, not the job's."""

    def each(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf[column]):
                try:
                    out.append((k, work(x), None, None))
                except Exception as e:  # noqa: BLE001 - any failure becomes the row's
                    out.append((k, None, str(e), type(e).__name__))
            yield pd.DataFrame(out, columns=[key, "result", "error", "error_type"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, column).mapInPandas(each, f"{key} {kind}, result string, error string, error_type string")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def watch(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json", per_trigger: int = 100) -> DataFrame:
    """A stream of the rows of files as they appear under `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def windowed(rows: DataFrame, time: str, length: str, keys: Sequence[str], *aggs: Column, late: str | None = None) -> DataFrame:
    """Aggregates by tumbling windows, of a table or a stream; `late` is a stream's watermark."""
    rows = rows if late is None else rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, length).alias("window"), *keys).agg(*aggs)


def sessions(rows: DataFrame, time: str, gap: str, keys: Sequence[str], *aggs: Column, late: str | None = None) -> DataFrame:
    rows = rows if late is None else rows.withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*aggs)


def undecided(steps: DataFrame, decisions: DataFrame, every: int, last: int) -> DataFrame:
    """Steps due for evaluation that have no decision yet."""
    from quillstone.functions.maths import evaluation_due

    return steps.where(evaluation_due(F.col("step"), every, last)).join(decisions.select("step"), "step", "left_anti")


def sync_every(stream: DataFrame, path: str, checkpoint: str, rows_per_file: int = 2500):
    """Write a stream to Parquet batch by batch; a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
