"""Manifest building and inspection: classification, splits, scenarios, problems, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.hashing import hash_split, keyed, scenario_seed
from quillstone.operators.aggregates import dimension, split_intersections, zero_filled
from quillstone.operators.joins import missing_either
from quillstone.operators.windows import drop_cross_split, top_k_per_group

# Fixed values.
SPLITS = ("train", "val", "test")
OFFICIAL = {"train": "train", "dev": "val", "test": "test"}
EXIT_CODES = {"passed": 0, "failed": 1, "insufficient_data": 3, "data_failed": 4}
SOURCE_FIELDS = ("source_utterance_id", "audio", "text", "language")
OFFICIAL_FIELDS = ("speaker_id", "official_split", "source_package")
MANIFEST_SCHEMA = "qwen3-asr-manifest-v2"


def split_mode(rows: DataFrame, touched: Column) -> DataFrame:
    """One row (mode): hash if no row is touched by official identity, official if all are, else mixed_split_mode."""
    n = rows.agg(F.count_if(touched).alias("t"), F.count("*").alias("n"))
    return n.select(F.when(F.col("t") == 0, "hash").when(F.col("t") == F.col("n"), "official").otherwise("mixed_split_mode").alias("mode"))


def official_problem(touched: Column) -> Column:
    ok = ~T.is_blank(F.col("speaker_id")) & ~T.is_blank(F.col("official_split"))
    return T.first_of(
        (touched & ~ok, "incomplete_official_identity"),
        (touched & ~F.col("speaker_id").rlike(T.SOURCE_ID), "bad_speaker_id"),
        (touched & ~F.col("official_split").isin(*OFFICIAL), "bad_official_split"),
        (touched & F.col("source_package").isNotNull() & ~F.col("source_package").rlike(T.SOURCE_ID), "bad_source_package"),
    )


def classify_sources(rows: DataFrame, known_audio: Column, unknown_field: Column, touched: Column | None = None) -> DataFrame:
    """`rows(line, source_id, text, language, audio, ...)` with reason, first reason wins, null if accepted.

    A row repeats a source if an accepted one of an earlier line has its id; so the first line
    whose other checks pass is the accepted one, which a minimum per id finds.
    """
    pre = T.first_of((unknown_field, "unknown_field"), (F.col("source_id").isNull() | ~T.is_source_id(F.col("source_id")), "bad_source_id"))
    later = F.coalesce(  # each check is worked out once, if those before it pass
        F.when(~F.coalesce(F.col("language"), F.lit("zh")).eqNullSafe("zh"), "language"),
        T.text_problem(F.col("text")),
        F.when(~F.coalesce(T.is_safe_path(F.col("audio")), F.lit(False)), "unsafe_audio_path"),
        F.when(~known_audio, "missing_audio"),
        *([] if touched is None else [official_problem(touched)]),
    )
    judged = rows.withColumns({"_pre": pre, "_post": later})
    good = judged.where("_pre is null and _post is null").groupBy(F.col("source_id").alias("_id")).agg(F.min("line").alias("_first"))
    judged = judged.join(good, F.col("source_id") == F.col("_id"), "left")
    reason = F.when(F.col("_pre").isNotNull(), F.col("_pre")).when(F.col("line") > F.col("_first"), "duplicate_source").otherwise(F.col("_post"))
    return judged.withColumn("reason", reason).drop("_pre", "_post", "_id", "_first")


def assign_splits(sources: DataFrame, seed: int, test: float, val: float, official: bool = False) -> DataFrame:
    if not official:
        return sources.withColumn("split", hash_split(seed, F.col("source_id"), test, val))
    name = F.create_map(*[F.lit(x) for kv in OFFICIAL.items() for x in kv])
    return sources.withColumn("split", F.element_at(name, F.col("official_split")))


def scenario_rows(sources: DataFrame, seed: int, failed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, rejected): a source's row for each scenario; if any of them fails, all go.

    `failed` is a column expression over a row with `scenario`: the failure's reason or null.
    """
    rows = sources.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in T.SCENARIOS])))
    rows = rows.withColumns({"sample_id": T.sample_id(F.col("source_id"), F.col("scenario")), "seed": scenario_seed(seed, F.col("source_id"), F.col("scenario"))})
    if failed is None:
        return rows, rows.limit(0).select("source_id", F.lit("").alias("reason"))
    rows = rows.withColumn("_why", failed)
    bad = rows.where("_why is not null").groupBy("source_id").agg(F.min_by("_why", F.array_position(F.array(*[F.lit(s) for s in T.SCENARIOS]), F.col("scenario"))).alias("reason"))
    return rows.drop("_why").join(bad, "source_id", "left_anti"), bad


def build_manifest(sources: DataFrame, known_audio: Column, unknown_field: Column, seed: int, test: float, val: float) -> tuple[DataFrame, DataFrame]:
    """(manifest rows, rejected(source_id, reason)) by classification, hash split and text first-wins."""
    judged = classify_sources(sources, known_audio, unknown_field)
    split = drop_cross_split(assign_splits(judged.where("reason is null").drop("reason"), seed, test, val), [("text", "text_cross_split")])
    rows, failed = scenario_rows(split.where("reason is null").drop("reason"), seed)
    rejected = judged.where("reason is not null").select("source_id", "reason").unionByName(split.where("reason is not null").select("source_id", "reason")).unionByName(failed)
    return rows.withColumn("schema_version", F.lit(MANIFEST_SCHEMA)), rejected


def manifest_problems(rows: DataFrame, fields: Sequence[str] = ("sample_id", "source_id", "audio", "text", "scenario", "split")) -> DataFrame:
    """Rows (code, key) of a manifest's problems.

    Codes: missing_<field>, bad_scenario, bad_split, sample_id_mismatch, duplicate_sample,
    source_scenarios (a source without all scenarios), source_text, and leak_source, leak_text
    and leak_speaker for keys in more than one split.
    """
    bad = [F.when(T.is_blank(F.col(f)), F.lit(f"missing_{f}")) for f in fields]
    bad += [
        F.when(~F.col("scenario").isin(*T.SCENARIOS), F.lit("bad_scenario")),
        F.when(~F.col("split").isin(*SPLITS), F.lit("bad_split")),
        F.when(F.col("sample_id") != T.sample_id(F.col("source_id"), F.col("scenario")), F.lit("sample_id_mismatch")),
    ]
    out = rows.select(F.explode(F.array_compact(F.array(*bad))).alias("code"), F.col("sample_id").alias("key"))
    again = rows.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_sample").alias("code"), F.col("sample_id").alias("key"))
    per = rows.groupBy("source_id").agg(F.count_distinct("scenario").alias("s"), F.count_distinct("text").alias("t"))
    out = out.unionByName(again)
    out = out.unionByName(per.where(F.col("s") < len(T.SCENARIOS)).select(F.lit("source_scenarios").alias("code"), F.col("source_id").alias("key")))
    out = out.unionByName(per.where("t > 1").select(F.lit("source_text").alias("code"), F.col("source_id").alias("key")))
    for key, code in (("source_id", "leak_source"), ("text", "leak_text"), ("speaker_id", "leak_speaker")):
        if key in rows.columns:
            out = out.unionByName(split_intersections(rows, key).select(F.lit(code).alias("code"), F.col(key).alias("key")))
    return out


def counts_by_split(rows: DataFrame) -> DataFrame:
    """Rows by split and scenario, zeros included."""
    return zero_filled(rows, dimension(rows.sparkSession, split=SPLITS, scenario=T.SCENARIOS), ["split", "scenario"], F.count("*").alias("rows"), F.count_distinct("source_id").alias("sources"))


def shortages(rows: DataFrame, val_floor: int, audited: bool = True) -> DataFrame:
    """Rows (shortage): scenarios of val below the floor, a train split without rows, sources not audited."""
    counts = counts_by_split(rows)
    out = counts.where((F.col("split") == "val") & (F.col("rows") < val_floor)).select(F.concat(F.lit("val_"), "scenario").alias("shortage"))
    train = counts.where("split = 'train'").agg(F.sum("rows").alias("n")).where("n < 1").select(F.lit("train_empty").alias("shortage"))
    out = out.unionByName(train)
    return out if audited else out.unionByName(rows.sparkSession.createDataFrame([("source_not_audited",)], "shortage string"))


def manifest_status(problems: DataFrame, short: DataFrame, data_codes: Sequence[str] = ("audio_missing", "audio_bad_header")) -> DataFrame:
    """One row (status, exit_code): failed before data_failed before insufficient_data before passed."""
    p = problems.agg(F.count_if(~F.col("code").isin(*data_codes)).alias("f"), F.count_if(F.col("code").isin(*data_codes)).alias("d"))
    s = short.agg(F.count("*").alias("s"))
    status = F.when(F.col("f") > 0, "failed").when(F.col("d") > 0, "data_failed").when(F.col("s") > 0, "insufficient_data").otherwise("passed")
    codes = F.create_map(*[F.lit(x) for kv in EXIT_CODES.items() for x in kv])
    return p.join(F.broadcast(s), F.lit(True)).select(status.alias("status"), F.element_at(codes, status).alias("exit_code"))


def pilot_eligibility(transcripts: DataFrame, durations: DataFrame, low_ms: int = 500, high_ms: int = 30_000) -> DataFrame:
    """Rows (utterance_id, reason): of a full outer join, why each utterance is not eligible, or null."""
    gone = missing_either(transcripts, durations, "utterance_id", "missing_duration", "missing_transcript", "duplicate_duration")
    once = durations.join(gone.where("reason = 'duplicate_duration'").select("utterance_id"), "utterance_id", "left_anti")
    both = transcripts.join(once, "utterance_id")
    reason = F.lit(None).cast("string")
    checks = [
        (~F.coalesce(F.col("official_split").isin(*OFFICIAL), F.lit(False)), F.lit("bad_official_split")),
        (T.text_problem(F.col("text")).isNotNull(), T.text_problem(F.col("text"))),
        (F.col("text").rlike(T.FULLWIDTH_LATIN), F.lit("fullwidth_latin")),
        (~F.coalesce(F.col("format_ok"), F.lit(False)), F.lit("bad_format")),
        (F.col("clipped_samples") > 0, F.lit("hard_clip")),
        (~F.coalesce(F.col("duration_ms").between(low_ms, high_ms), F.lit(False)), F.lit("duration_out_of_range")),
    ]
    for cond, why in reversed(checks):
        reason = F.when(cond, why).otherwise(reason)
    return both.select("utterance_id", reason.alias("reason")).unionByName(gone)


def duplicate_texts(rows: DataFrame, seed: int, label: str, key: str = "utterance_id") -> DataFrame:
    """`rows` with reason duplicate_text on all but the smallest rank of each text."""
    rank = keyed(seed, F.col(key), label)
    lead = F.struct(rank.alias("r"), F.col(key).alias("k"))
    first = rows.groupBy(F.col("text").alias("_t")).agg(F.min(lead).alias("_first"))
    return rows.join(first, F.col("text") == F.col("_t")).withColumn("reason", F.when(lead != F.col("_first"), "duplicate_text")).drop("_t", "_first")


def builder_rows(selected: DataFrame, prefix: str) -> DataFrame:
    """Selected utterances as source rows of the manifest builder, by id."""
    return selected.select(
        F.col("utterance_id").alias("source_utterance_id"), F.format_string(f"{prefix}/%s/%s.wav", "speaker_id", "utterance_id").alias("audio"),
        "text", F.lit("zh").alias("language"), "speaker_id", "official_split",
    ).orderBy("source_utterance_id")


def training_row_problems(rows: DataFrame) -> DataFrame:
    """Rows (key, code) of `rows(sample_id, language, text, audio)` that can't be trained on: language, blank_text, blank_audio, duplicate_sample."""
    checks = {
        "language": ~F.col("language").eqNullSafe("zh"), "blank_text": T.is_blank(F.col("text")), "blank_audio": T.is_blank(F.col("audio")),
    }
    each = rows.select(F.col("sample_id").alias("key"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("code"))
    again = rows.groupBy(F.col("sample_id").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("duplicate_sample").alias("code"))
    return each.unionByName(again)


def smoke_sources(rows: DataFrame, seed: int, k: int) -> DataFrame:
    """The k sources a split, by rank, that have all scenarios there, with position from 1."""
    whole = rows.where(F.col("scenario").isin(*T.SCENARIOS)).groupBy("split", "source_id").agg(F.count_distinct("scenario").alias("n"))
    whole = whole.where(F.col("n") == len(T.SCENARIOS)).drop("n")
    return top_k_per_group(whole, ["split"], keyed(seed, F.col("source_id"), "smoke"), k, "source_id")


def summary_diff(stored: DataFrame, computed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows (key, problem) where a stored summary is not the one computed anew: not_stored, not_computed, differs."""
    a = stored.select(F.col(key), F.struct(*columns).alias("_a"), F.lit(True).alias("_s"))
    b = computed.select(F.col(key), F.struct(*columns).alias("_b"), F.lit(True).alias("_c"))
    problem = T.first_of((F.col("_s").isNull(), "not_stored"), (F.col("_c").isNull(), "not_computed"), (~F.col("_a").eqNullSafe(F.col("_b")), "differs"))
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")
