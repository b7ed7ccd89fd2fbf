"""JSON-lines, transcript, index and lock readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstone.functions.text import squeeze, strip
from quillstone.operators.windows import global_index

_BAD = "_corrupt"


class SourceError(ValueError):
    """A file that a strict reader refuses; `problems` lists where and why."""

    def __init__(self, message: str, problems: DataFrame):
        super().__init__(message)
        self.problems = problems


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows (file, _line, value) of the lines that aren't blank, _line from 1 within a file.

    Spark splits large files, so a line's number is its place in the order of the file's
    splits; `monotonically_increasing_id` has that order within a scan.
    """
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("_at"))
    placed = global_index(raw, ["file", "_at"], "_all")
    first = placed.groupBy("file").agg(F.min("_all").alias("_first"))
    out = placed.join(first, "file").select("file", (F.col("_all") - F.col("_first") + 1).alias("_line"), "value")
    return out.where(strip(F.col("value")) != "")


def read_lenient(spark: SparkSession, path: str | Sequence[str], schema: StructType, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): parsed rows with file, _line and _keys (the keys that were present), and
    rows (file, _line, problem): malformed, not_object, or split_mismatch against the file's split."""
    full = StructType([*schema.fields, StructField(_BAD, StringType())])
    text = F.col("value")
    parsed = lines(spark, path).withColumn("_p", F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    problem = F.when(F.try_parse_json(text).isNull(), "malformed").when(~strip(text).startswith("{"), "not_object").when(F.col(f"_p.{_BAD}").isNotNull(), "malformed")
    if split is not None and "split" in schema.names:
        problem = problem.when(~F.col("_p.split").eqNullSafe(split), "split_mismatch")
    judged = parsed.withColumn("_problem", problem)
    rows = judged.where("_problem is null").select(*[F.col(f"_p.{n}").alias(n) for n in schema.names], F.json_object_keys(text).alias("_keys"), "file", "_line")
    return rows, judged.where("_problem is not null").select("file", "_line", F.col("_problem").alias("problem"))


def read_strict(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> DataFrame:
    """As `read_lenient`, but any problem raises SourceError that names the first."""
    rows, problems = read_lenient(spark, path, schema)
    first = problems.orderBy("file", "_line").limit(1).collect()
    if first:
        raise SourceError(f"{first[0]['file']}:{first[0]['_line']} {first[0]['problem']}", problems)
    return rows


def unknown_fields(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows (file, _line, fields) with keys that are not allowed."""
    extra = F.array_except("_keys", F.array(*[F.lit(a) for a in allowed]))
    return rows.select("file", "_line", extra.alias("fields")).where(F.size("fields") > 0)


def check_rejected(rows: DataFrame, schema_version: str) -> DataFrame:
    """Rows (file, _line, problem) of a rejected file: another schema, or no reason."""
    problem = F.when(~F.col("schema_version").eqNullSafe(schema_version), "schema_version").when(F.coalesce(strip(F.col("reason")), F.lit("")) == "", "empty_reason")
    return rows.select("file", "_line", problem.alias("problem")).where("problem is not null")


def read_transcript(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Rows (utterance_id, text) of lines "id words...": words joined without white space, the last line of an id wins.

    With `known(utterance_id)`, other ids are passed over.
    """
    parts = F.split(strip(F.col("value")), r"(?U)\s+", 2)
    rows = lines(spark, path).select(parts[0].alias("utterance_id"), squeeze(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("text"), F.struct("file", "_line").alias("_at"))
    out = rows.groupBy("utterance_id").agg(F.max_by("text", "_at").alias("text"))
    return out if known is None else out.join(known.select("utterance_id").distinct(), "utterance_id", "left_semi")


def read_sha_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, sha256) of an index document whose `files` is a list of objects or a map."""
    doc = spark.read.text(path, wholetext=True).select("value")
    listed = doc.select(F.from_json("value", "files array<struct<name:string,sha256:string>>")["files"].alias("f"))
    mapped = doc.select(F.from_json("value", "files map<string,string>")["files"].alias("f"))
    return listed.where("f is not null").select(F.inline("f")).where("name is not null").unionByName(mapped.where("f is not null").select(F.explode("f").alias("name", "sha256")))


def read_lock(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows (kind, name, expected) of a lock file: verify pins after "# verify:", install pins on lines of their own.

    A wrong schema line, a pin that is not name==version, or no pin of either kind raises.
    """
    v = strip(F.col("value"))
    rows = lines(spark, path).select(v.alias("v"))
    if rows.where(F.col("v") == f"# schema: {schema}").isEmpty():
        raise ValueError(f"the lock's schema is not {schema}")
    kind = F.when(F.col("v").startswith("# verify:"), "verify").when(~F.col("v").startswith("#"), "install")
    pins = rows.select(kind.alias("kind"), strip(F.regexp_replace("v", "^# verify:", "")).alias("pin")).where("kind is not null")
    parts = F.split("pin", "==")
    pins = pins.select("kind", strip(parts[0]).alias("name"), strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("expected"), F.size(parts).alias("n"))
    bad = (F.col("n") != 2) | (F.col("name") == "") | (F.col("expected") == "") | F.col("name").rlike("[ <>!]")
    if not pins.where(bad).isEmpty() or pins.select("kind").distinct().count() < 2:
        raise ValueError("pins must be name==version, of both kinds")
    return pins.drop("n")


def compare_pins(pins: DataFrame, actual: DataFrame) -> DataFrame:
    """`pins` with actual and match; an absent one doesn't match."""
    got = actual.select("name", F.col("version").alias("actual"))
    return pins.join(got, "name", "left").withColumn("match", F.col("expected").eqNullSafe(F.col("actual")))
