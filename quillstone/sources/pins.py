"""Snapshots of files around a job: what it read must be what it was told to read, before and after."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import first_of
from quillstone.shared import cut
from quillstone.sources.sinks import _fs, directory_index


class PinError(ValueError):
    """Inputs or an output that a build may not use; `report` has the cause of each."""

    def __init__(self, causes: Sequence[str], report: DataFrame | None = None):
        super().__init__("; ".join(causes))
        self.causes, self.report = list(causes), report


def snapshot(spark: SparkSession, inputs: dict[str, str]) -> DataFrame:
    """Rows (label, name, sha256, bytes) of all files of the labelled paths."""
    out = None
    for label, path in inputs.items():
        rows = directory_index(spark, path).withColumn("label", F.lit(label)).select("label", "name", "sha256", "bytes")
        out = rows if out is None else out.unionByName(rows)
    return out


def changes(before: DataFrame, after: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Rows (label, name, problem): files gone, added or changed between two snapshots, or not as `expected(label, name, sha256)`.

    Expected files that were never there are missing; others than expected ones are not judged by it.
    """
    key = ["label", "name"]
    a = before.select(*key, F.col("sha256").alias("a"))
    b = after.select(*key, F.col("sha256").alias("b"))
    both = a.join(b, key, "full_outer")
    if expected is None:
        both = both.withColumn("e", F.lit(None).cast("string"))
    else:
        both = both.join(expected.select(*key, F.col("sha256").alias("e")), key, "full_outer")
    problem = first_of(
        (F.col("a").isNull() & F.col("b").isNull(), "missing"), (F.col("e").isNotNull() & ~F.col("a").eqNullSafe(F.col("e")), "not_as_expected"),
        (F.col("b").isNull(), "gone_during_build"), (F.col("a").isNull(), "added_during_build"), (F.col("a") != F.col("b"), "changed_during_build"),
    )
    return both.select(*key, problem.alias("problem")).where("problem is not null")


def output_problems(spark: SparkSession, inputs: dict[str, str], output: str, frozen: Sequence[str] = ()) -> list[str]:
    """Why `output` may not be written: its name is frozen, it is there already, or it is, holds or lies in an input."""
    full = lambda p: _fs(spark, p)[0].makeQualified(_fs(spark, p)[1]).toString().rstrip("/")
    at = full(output)
    out = ["frozen_name"] if at.rsplit("/", 1)[-1] in frozen else []
    if _fs(spark, output)[0].exists(_fs(spark, output)[1]):
        out.append("exists")
    for label, path in inputs.items():
        source = full(path)
        if f"{at}/".startswith(f"{source}/") or f"{source}/".startswith(f"{at}/"):
            out.append(f"overlaps_input:{label}")
    return out


def guarded(spark: SparkSession, inputs: dict[str, str], output: str, build: Callable[[str], None], expected: DataFrame | None = None, frozen: Sequence[str] = (), keep: str | None = None) -> DataFrame:
    """Run `build(output)` between two snapshots of its inputs; gives the snapshot.

    A refused output, or an input that isn't as expected, raises PinError before the build; one that changed
    meanwhile raises after it, and what was built is removed. With `keep` the snapshot is written there.
    """
    if refused := output_problems(spark, inputs, output, frozen):
        raise PinError(refused)
    before = cut(snapshot(spark, inputs))
    early = changes(before, before, expected)
    if not early.isEmpty():
        raise PinError([f"{r['label']}/{r['name']}: {r['problem']}" for r in early.orderBy("label", "name").limit(20).collect()], early)
    build(output)
    after = snapshot(spark, inputs)
    late = changes(before, after)
    if not late.isEmpty():
        causes = [f"{r['label']}/{r['name']}: {r['problem']}" for r in late.orderBy("label", "name").limit(20).collect()]
        _fs(spark, output)[0].delete(_fs(spark, output)[1], True)
        raise PinError(causes, late)
    if keep:
        after.write.mode("errorifexists").json(keep)
    return before
