"""Meeting intervals: filters with reasons, near/far twins, rejects, release read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.joins import band_match, interval_overlaps


def classify_intervals(near: DataFrame, far: DataFrame, eps: float, low_s: float, high_s: float, drift: float, diff: float, norm=T.normalize) -> DataFrame:
    """`near(id, meeting, speaker, xmin, xmax, text)` with text cleaned, far_id and reason.

    Checks in order: the text's own reason, duration_out_of_range, overlap (another active
    speaker of the meeting), unpaired_far_interval, far_overlap.
    """
    out = near.withColumn("_c", T.clean_transcript(F.col("text"), norm=norm))
    out = out.withColumn("_length", F.col("xmax") - F.col("xmin"))
    active = near.where(T.is_active_speech(F.col("text")))
    crossed = interval_overlaps(active, "meeting", "speaker", eps).withColumn("_crossed", F.lit(True))
    heard = far.withColumn("_c", T.clean_transcript(F.col("text"), norm=norm)).where("_c.reason is null").select("id", "meeting", "speaker", "xmin", "xmax", F.col("_c.text").alias("text"))
    wanted = out.where("_c.reason is null").select("id", "meeting", "speaker", "xmin", "xmax", F.col("_c.text").alias("text"))
    paired = band_match(wanted, heard, ["meeting", "text"], drift, diff).select("id", "matches", "far_id")
    crossed_far = interval_overlaps(far.where(T.is_active_speech(F.col("text"))), "meeting", "speaker", eps).select(F.col("id").alias("far_id"), F.lit(True).alias("_far_crossed"))
    out = out.join(crossed, "id", "left").join(paired, "id", "left").join(crossed_far, "far_id", "left")
    late = F.when(~F.col("_length").between(low_s, high_s), "duration_out_of_range").when(F.col("_crossed"), "overlap").when(F.coalesce(F.col("matches"), F.lit(0)) != 1, "unpaired_far_interval").when(F.col("_far_crossed"), "far_overlap")
    return out.select("id", "meeting", "speaker", "xmin", "xmax", F.col("_c.text").alias("text"), "far_id", F.coalesce("_c.reason", late).alias("reason"))


def twin_rows(selected: DataFrame) -> DataFrame:
    """A near and a far row for each selected source."""
    twins = F.explode(F.array(F.lit("near_field"), F.lit("far_field")))
    sid = T.interval_id(F.col("meeting"), F.col("speaker"), F.col("xmin"), F.col("xmax"))
    out = selected.withColumns({"source_id": sid, "scenario": twins})
    return out.withColumns({"sample_id": T.sample_id(F.col("source_id"), F.col("scenario")), "split": F.lit("ood_eval"), "duration_sec": F.col("xmax") - F.col("xmin")})


def rejects(rows: DataFrame, key: str, schema_version: str) -> DataFrame:
    """Rejected rows in one schema; a row without an accepted id goes by its line."""
    own = F.when(T.is_source_id(F.col(key)), F.col(key)).otherwise(F.concat(F.lit("line-"), F.col("line").cast("string")))
    return rows.where("reason is not null").select(F.lit(schema_version).alias("schema_version"), own.alias("sample_id"), "reason")


def prediction_rows(rows: DataFrame, model: str, seed: int) -> DataFrame:
    """The closed projection of decoder results: a row has a result or an error, never both."""
    failed = ~T.is_blank(F.col("error"))
    kept = lambda c: F.when(~failed, F.col(c)).alias(c)
    return rows.select(
        F.lit("qwen3-asr-prediction-v1").alias("schema_version"), "sample_id", "audio", "language", "scenario", "source_id", "text",
        kept("prediction_raw"), F.when(~failed, T.normalize("prediction_raw")).alias("prediction_normalized"), kept("generation_raw"), kept("token_ids"),
        F.when(failed, "error").otherwise(F.col("stop_reason")).alias("stop_reason"), F.when(failed, F.col("error")).alias("error"), kept("transcribe_text"),
        F.when(~failed, F.col("transcribe_text").eqNullSafe(F.col("prediction_raw"))).alias("transcribe_matches_greedy"), F.lit(model).alias("model"), F.lit(seed).alias("seed"),
    )


def greedy_map(rows: DataFrame) -> DataFrame:
    """(sample_id, prediction_raw, stop_reason, error) with a null error as the empty text, for read-back."""
    return rows.select("sample_id", "prediction_raw", "stop_reason", F.coalesce("error", F.lit("")).alias("error"))
