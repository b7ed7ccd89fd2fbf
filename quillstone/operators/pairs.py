"""Preference pairs: building, filtering, gap stripping, validation, log-prob cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import maths
from quillstone.functions import sequence as S
from quillstone.functions import text as T
from quillstone.operators.joins import strict_one_to_one


def classify_pairs(rows: DataFrame, most_tokens: int, norm=T.normalize, tokens=T.char_token_count) -> DataFrame:
    """`rows(sample_id, reference, prediction, error, ...)` as pairs with bucket and reason.

    In order: inference_error, empty_rejected, tie (no edit) are rejected; either side longer
    than most_tokens + 1 is overlength; the rest are pairs.
    """
    score = S.scored(F.col("reference"), F.col("prediction"), F.lit(None).cast("string"), F.col("stop_reason"), norm)
    out = rows.withColumns({
        "chosen_text": F.col("reference"), "rejected_text": F.coalesce("prediction", F.lit("")),
        "chosen_cer": F.lit(0.0), "rejected_cer": score["sample_cer"], "edit_count": score["edit_count"],
        "reference_char_count": score["reference_char_count"], "rejected_char_count": F.length(score["prediction_normalized"]).cast("long"),
        "char_length_delta": (F.length(score["prediction_normalized"]) - score["reference_char_count"]).cast("long"),
        "chosen_token_count": tokens(F.col("reference")).cast("long"), "rejected_token_count": tokens(F.coalesce("prediction", F.lit(""))).cast("long"),
        "_empty": score["prediction_normalized"] == "",
    })
    reason = T.first_of((~T.is_blank(F.col("error")), "inference_error"), (F.col("_empty"), "empty_rejected"), (F.col("edit_count") == 0, "tie"))
    long = (F.col("chosen_token_count") > most_tokens + 1) | (F.col("rejected_token_count") > most_tokens + 1)
    out = out.withColumn("reason", F.coalesce(reason, F.when(long, "overlength")))
    bucket = F.when(F.col("reason").isNull(), "pair").when(F.col("reason") == "overlength", "overlength").otherwise("rejected")
    return out.withColumn("bucket", bucket).drop("_empty")


def published(pairs: DataFrame) -> DataFrame:
    return pairs.where("bucket = 'pair'").drop("bucket", "reason")


def strip_gaps(pairs: DataFrame, most_tokens: int, norm=T.normalize, tokens=T.char_token_count) -> DataFrame:
    """Pairs with the gap band of dropout rows cut from both sides and scored anew, with bucket and reason.

    Other scenarios pass through. Log-probs are emptied, as they no longer belong to the texts.
    """
    empty = {c: F.lit(None).cast("double") for c in ("ref_chosen_logp", "ref_rejected_logp")}
    other = pairs.where("scenario <> 'dropout'").withColumns(empty | {"bucket": F.lit("pair"), "reason": F.lit(None).cast("string")})
    cut = pairs.where("scenario = 'dropout'").withColumn("_s", S.strip_gap(norm(F.col("chosen_text")), norm(F.col("rejected_text"))))
    chosen, rejected = F.col("_s.chosen"), F.col("_s.rejected")
    edits = F.levenshtein(norm(chosen), norm(rejected)).cast("long")
    cut = cut.withColumns(empty | {
        "chosen_text": chosen, "rejected_text": rejected, "edit_count": edits, "rejected_cer": F.try_divide(edits.cast("double"), F.length(norm(chosen)).cast("double")),
        "reference_char_count": F.length(norm(chosen)).cast("long"), "rejected_char_count": F.length(norm(rejected)).cast("long"),
        "char_length_delta": (F.length(norm(rejected)) - F.length(norm(chosen))).cast("long"),
        "chosen_token_count": tokens(chosen).cast("long"), "rejected_token_count": tokens(rejected).cast("long"),
    })
    long = (F.col("chosen_token_count") > most_tokens + 1) | (F.col("rejected_token_count") > most_tokens + 1)
    reason = T.first_of((F.col("rejected_char_count") == 0, "empty_rejected_after_strip"), (F.col("edit_count") == 0, "tie_after_strip"), (long, "overlength"))
    bucket = F.when(reason.isNull(), "pair").when(reason == "overlength", "overlength").otherwise("rejected")
    cut = cut.withColumns({"reason": reason, "bucket": bucket}).drop("_s")
    return other.unionByName(cut.select(*other.columns))


def aligned_substitution(most: int, norm=T.normalize) -> Column:
    """Whether a pair differs by 1 to `most` substitutions only: no punctuation, equal lengths and token counts."""
    a, b = F.col("chosen_text"), F.col("rejected_text")
    h = S.hamming(a, b)
    ok = ~T.has_punctuation(a, norm) & ~T.has_punctuation(b, norm) & (F.length(a) == F.length(b)) & (F.col("char_length_delta") == 0)
    return ok & (F.col("chosen_token_count") == F.col("rejected_token_count")) & h.between(1, most) & (F.col("edit_count") <= most) & (h == F.levenshtein(a, b))


def filter_pairs(
    pairs: DataFrame, scenarios: Sequence[str] | None = None, exclude_clean: bool = False, aligned_most: int | None = None,
    most_edits: int | None = None, margin: tuple[float, float] | None = None, norm=T.normalize,
) -> DataFrame:
    """The training pairs that pass each filter that is asked for, in order.

    exclude_clean drops clean rows, and rows whose rejected text, normalised, is that of their
    source's clean row (the last one by line). Margins that aren't finite fail a margin band.
    """
    clean = pairs.where("scenario = 'clean'").groupBy(F.col("source_id").alias("_src")).agg(F.max_by(norm(F.col("rejected_text")), "line").alias("_clean"))
    out = pairs
    if scenarios is not None:
        out = out.where(F.col("scenario").isin(*scenarios))
    if exclude_clean:
        out = out.where("scenario <> 'clean'").join(clean, F.col("source_id") == F.col("_src"), "left")
        out = out.where(F.col("_clean").isNull() | (norm(F.col("rejected_text")) != F.col("_clean"))).drop("_src", "_clean")
    if aligned_most is not None:
        out = out.where(aligned_substitution(aligned_most, norm))
    if most_edits is not None:
        out = out.where(F.col("edit_count") <= most_edits)
    if margin is not None:
        d = F.col("ref_chosen_logp") - F.col("ref_rejected_logp")
        out = out.where(maths.finite(d) & d.between(*margin))
    return out


def dropout_anchors(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("scenario") == "dropout") & (F.col("split").isNull() | (F.col("split") == "train")) & ~T.is_blank(F.col("rejected_text")))


def pair_problems(pairs: DataFrame, split: str, floor: int = 0) -> DataFrame:
    """Rows (code, key) of pairs that break the training contract, and scenarios below the floor."""
    checks = {
        "bad_split": ~F.col("split").eqNullSafe(split), "bad_scenario": ~F.coalesce(F.col("scenario").isin(*T.SCENARIOS), F.lit(False)),
        "chosen_is_not_reference": ~F.col("chosen_text").eqNullSafe(F.col("reference")), "blank_rejected": T.is_blank(F.col("rejected_text")),
        "logp_not_finite": ~F.coalesce(maths.finite(F.col("ref_chosen_logp")) & maths.finite(F.col("ref_rejected_logp")), F.lit(False)),
        "token_count": ~F.coalesce((F.col("chosen_token_count") >= 1) & (F.col("rejected_token_count") >= 1), F.lit(False)),
        "no_length_delta": F.col("char_length_delta").isNull(),
    }
    each = pairs.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("code"), F.col("pair_id").cast("string").alias("key"))
    again = pairs.groupBy("pair_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_pair").alias("code"), F.col("pair_id").cast("string").alias("key"))
    few = pairs.groupBy("scenario").agg(F.count("*").alias("n")).where(F.col("n") < floor).select(F.lit("scenario_floor").alias("code"), F.col("scenario").alias("key"))
    return each.unionByName(again).unionByName(few)


def fill_logprobs(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs with the cache's reference log-probs; every pair needs exactly one."""
    bare = pairs.drop("ref_chosen_logp", "ref_rejected_logp")
    return strict_one_to_one(bare, cache.select("pair_id", "ref_chosen_logp", "ref_rejected_logp"), "pair_id")


def recheck(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: the largest errors of log-probs scored again, and whether all are within tolerance."""
    both = cache.join(fresh.select("pair_id", F.col("ref_chosen_logp").alias("_c"), F.col("ref_rejected_logp").alias("_r")), "pair_id")
    side = both.select(F.explode(F.array(maths.matches_within(F.col("ref_chosen_logp"), F.col("_c")), maths.matches_within(F.col("ref_rejected_logp"), F.col("_r")))).alias("m"))
    return side.agg(F.max("m.abs_error").alias("max_abs_error"), F.max("m.rel_error").alias("max_rel_error"), F.every("m.ok").alias("ok"))


def aligned_mask(candidates: DataFrame, group: str, most: int = 2) -> DataFrame:
    """(group, valid, best_index, mismatch_index, aligned, advantages) of rollout groups.

    The first candidate of the highest reward is the anchor; candidates with its ids are
    positive, those of its length and last id that differ in 1 to `most` places and earn less are
    negative. Negatives that first differ where the first of them does count, and advantages
    are centred over them and the positives. A group is one rollout's few candidates.
    """
    c = F.struct("candidate_index", "reward", F.transform("label_ids", lambda x: x).alias("ids"), F.coalesce("punctuated", F.lit(True)).alias("bad"))
    g = candidates.groupBy(group).agg(F.array_sort(F.collect_list(c)).alias("cs"))
    top = F.array_max(F.transform("cs", lambda x: x["reward"]))
    g = g.withColumn("best", F.get(F.filter("cs", lambda x: x["reward"] == top), F.lit(0)))
    diffs = lambda x: F.filter(F.transform(F.sequence(F.lit(0), F.size("best.ids") - 1), lambda i: F.when(F.get(x["ids"], i) != F.get(F.col("best.ids"), i), i)), lambda i: i.isNotNull())
    fit = lambda x: ~x["bad"] & (F.size(x["ids"]) == F.size("best.ids"))
    usable = (F.size("best.ids") >= 2) & ~F.col("best.bad")
    g = g.withColumn("pos", F.when(usable, F.filter("cs", lambda x: fit(x) & (x["ids"] == F.col("best.ids")))))
    negative = lambda x: fit(x) & (F.element_at(x["ids"], -1) == F.element_at("best.ids", -1)) & F.size(diffs(x)).between(1, most) & (x["reward"] < F.col("best.reward") - 1e-12)
    g = g.withColumn("neg", F.when(usable, F.transform(F.filter("cs", negative), lambda x: F.struct(x.alias("c"), F.get(diffs(x), F.lit(0)).alias("at")))))
    g = g.withColumn("t0", F.get(F.transform("neg", lambda x: x["at"]), F.lit(0)))
    g = g.withColumn("used", F.array_sort(F.concat("pos", F.transform(F.filter("neg", lambda x: x["at"] == F.col("t0")), lambda x: x["c"]))))
    g = g.withColumn("mean", maths.mean(F.transform("used", lambda x: x["reward"])))
    g = g.withColumn("adv", F.transform("used", lambda x: x["reward"] - F.col("mean")))
    valid = F.coalesce((F.size("pos") > 0) & (F.size("neg") > 0) & F.exists("adv", lambda a: F.abs(a) > 1e-12), F.lit(False))
    return g.select(
        group, valid.alias("valid"), F.col("best.candidate_index").alias("best_index"), F.when(valid, F.col("t0")).alias("mismatch_index"),
        F.when(valid, F.transform("used", lambda x: x["candidate_index"])).alias("aligned"), F.when(valid, F.col("adv")).alias("advantages"),
    )


def strip_input_problems(rows: DataFrame, schema: str, sha_wanted: str, sha_found: str) -> DataFrame:
    """Rows (key, code) of pairs that must not be stripped: another schema, duplicates, a chosen text
    that is not the reference, and the source file's digest where it is not the pinned one."""
    checks = {"schema": ~F.col("schema_version").eqNullSafe(schema), "chosen_is_not_reference": ~F.col("chosen_text").eqNullSafe(F.col("reference"))}
    key = F.col("pair_id").cast("string").alias("key")
    each = rows.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("code"))
    again = rows.groupBy("pair_id").agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate_pair").alias("code"))
    out = each.unionByName(again)
    if sha_wanted != sha_found:
        out = out.unionByName(rows.sparkSession.createDataFrame([("source", "sha_changed")], "key string, code string"))
    return out


def strip_status(pairs: DataFrame, name: str, frozen: Sequence[str], floor: int) -> str:
    """How a gap-strip build ends: refused for a frozen name, else insufficient_data or passed.

    Every scenario that occurs needs `floor` pairs.
    """
    if name in frozen:
        raise ValueError(f"{name} is frozen")
    few = pairs.groupBy("scenario").agg(F.count_if(F.col("bucket") == "pair").alias("n")).where(F.col("n") < floor)
    return "passed" if few.isEmpty() else "insufficient_data"


def audit_problems(rows: DataFrame, dispositions: Sequence[str] = ("keep", "drop")) -> DataFrame:
    """Rows (key, code) of audited `rows(pair_id, disposition, note)`: not_reviewed, bad_disposition, or no_note where a pair goes."""
    code = T.first_of(
        (F.col("disposition").isNull(), "not_reviewed"), (~F.col("disposition").isin(*dispositions), "bad_disposition"),
        ((F.col("disposition") == "drop") & T.is_blank(F.col("note")), "no_note"),
    )
    return rows.select(F.col("pair_id").cast("string").alias("key"), code.alias("code")).where("code is not null")
