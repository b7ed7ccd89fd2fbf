"""WAV files and archives of them: headers, statistics, samples."""

from __future__ import annotations

import io
import tarfile
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

RATE = 16_000
STATS = StructType([
    StructField("format_ok", BooleanType()), StructField("format_problem", StringType()), StructField("channels", IntegerType()),
    StructField("sample_width", IntegerType()), StructField("sample_rate", IntegerType()), StructField("duration_seconds", DoubleType()), StructField("clipped_samples", LongType()),
])


def _pcm(data: bytes) -> tuple[dict, np.ndarray | None]:
    """The header's facts and, of 16 kHz mono PCM16, the samples."""
    try:
        with wave.open(io.BytesIO(data), "rb") as f:
            head = {"channels": f.getnchannels(), "sample_width": f.getsampwidth(), "sample_rate": f.getframerate()}
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return {"format_problem": "bad_wav"}, None
    if tuple(head.values()) != (1, 2, RATE):
        return {**head, "format_problem": "bad_format"}, None
    if len(raw) % 2:
        return {**head, "format_problem": "odd_pcm_bytes"}, None
    return head, np.frombuffer(raw, "<i2")


def stats_of(data: bytes) -> dict:
    head, samples = _pcm(data)
    if samples is not None:
        head |= {"duration_seconds": len(samples) / RATE, "clipped_samples": int(((samples == 32767) | (samples == -32768)).sum())}
    return {n: head.get(n) for n in STATS.names} | {"format_ok": samples is not None}


@pandas_udf(STATS)
def pcm_stats(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stats_of(bytes(c)) for c in content], columns=STATS.names).astype({"channels": "Int32", "sample_width": "Int32", "sample_rate": "Int32", "clipped_samples": "Int64"})


@pandas_udf(ArrayType(FloatType()))
def pcm_samples(content: pd.Series) -> pd.Series:
    """Samples over 32768; null where the file is not 16 kHz mono PCM16."""
    found = (_pcm(bytes(c))[1] for c in content)
    return pd.Series([None if x is None else x.astype(np.float32) / np.float32(32768) for x in found])


def wav_problem(length: Column, content: Column) -> Column:
    """missing, short (under 44 bytes) or header, else null."""
    head = F.substring(content, 1, 4) == F.lit(b"RIFF")
    kind = F.substring(content, 9, 4) == F.lit(b"WAVE")
    return F.when(content.isNull(), "missing").when(length < 44, "short").when(~(head & kind), "header")


def wavs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path", "length", "content")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows (utterance_id, speaker_id, official_split, statistics...) of the recordings in gzipped tars under `path`.

    A tar holds recordings as split/.../utterance.wav, or further gzipped tars of them. A tar is
    one task's work, read member by member, so no more than a recording is in memory beside it.
    """

    def members(data: bytes) -> Iterator[tuple[str, bytes]]:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as tar:
            for m in tar:
                if not m.isfile():
                    continue
                body = tar.extractfile(m).read()
                if m.name.endswith((".tar.gz", ".tgz")):
                    yield from members(body)
                elif m.name.endswith(".wav"):
                    yield m.name, body

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for name, body in members(bytes(content)):
                    parts = [p for p in name.split("/") if p not in ("", ".", "wav")]
                    row = {"utterance_id": parts[-1][:-4], "official_split": parts[0] if len(parts) > 1 else None, **stats_of(body)}
                    yield pd.DataFrame([row]).astype({"channels": "Int32", "sample_width": "Int32", "sample_rate": "Int32", "clipped_samples": "Int64"})

    from quillstone.functions.text import utterance_speaker

    schema = StructType([StructField("utterance_id", StringType()), StructField("official_split", StringType()), *STATS.fields])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tar.gz").load(path).select("content")
    return files.mapInPandas(each, schema).withColumn("speaker_id", utterance_speaker(F.col("utterance_id")))


def catalog_summary(rows: DataFrame) -> DataFrame:
    """Rows (what, name, n): recordings by split and by problem, and speakers in more or fewer than one split."""
    split = rows.groupBy(F.lit("split").alias("what"), F.col("official_split").alias("name")).agg(F.count("*").alias("n"))
    bad = rows.where("not format_ok").groupBy(F.lit("problem").alias("what"), F.col("format_problem").alias("name")).agg(F.count("*").alias("n"))
    per = rows.groupBy("speaker_id").agg(F.count_distinct("official_split").alias("n")).where("n <> 1")
    return split.unionByName(bad).unionByName(per.select(F.lit("speaker_conflict").alias("what"), F.col("speaker_id").alias("name"), "n"))
