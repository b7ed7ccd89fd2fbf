"""Checkpoint gates: metrics against limits, as violations and a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import SCENARIOS
from quillstone.operators.aggregates import ratio

DEGRADED = ("dropout", "far_field", "noise", "reverb")


def _named(rows: DataFrame, cond: Column, code: str, scope: Column, value: Column) -> DataFrame:
    return rows.where(cond).select(F.lit(code).alias("code"), scope.alias("scope"), value.cast("double").alias("value"))


def sft_violations(metrics: DataFrame, baseline: DataFrame, gate: dict[str, float]) -> DataFrame:
    """Rows (code, scope, value) where `metrics(scenario, samples, micro_cer, rates...)` breaks the gate.

    Rows floor and rate caps hold for each scenario and overall; rate of clean, of each degraded
    scenario and of their macro mean may rise over the baseline by their caps at most.
    """
    at = F.col("scenario")
    known = metrics.where(at.isin("overall", *SCENARIOS))
    out = _named(known.where(at != "overall"), F.col("samples") < gate["min_rows_per_scenario"], "rows", at, F.col("samples"))
    for rate in ("empty_rate", "repeated_rate", "long_rate", "truncation_rate"):
        out = out.unionByName(_named(known, F.col(rate) > gate[f"{rate}_max"], rate, at, F.col(rate)))
    out = out.unionByName(_named(known, F.col("valid_output_rate") < gate["valid_output_rate_min"], "valid_output_rate", at, F.col("valid_output_rate")))
    base = baseline.select("scenario", F.col("micro_cer").alias("_base"))
    deltas = metrics.join(base, "scenario").withColumn("delta", F.col("micro_cer") - F.col("_base"))
    d = F.col("delta")
    clean = deltas.where("scenario = 'clean'")
    out = out.unionByName(_named(clean, d > gate["clean_cer_increase_max"], "clean_increase", at, d))
    out = out.unionByName(_named(clean, d > gate["clean_cer_increase_vs_base_max"], "clean_increase_vs_base", at, d))
    out = out.unionByName(_named(deltas.where(at.isin(*DEGRADED)), d > gate["scenario_cer_increase_max"], "scenario_increase", at, d))
    macro = macro_delta(metrics, baseline)
    return out.unionByName(_named(macro, F.col("macro_delta") > gate["degraded_macro_increase_max"], "macro_increase", F.lit("degraded"), F.col("macro_delta")))


def macro_delta(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: the degraded macro rate and its rise over the baseline's."""
    mean = ratio(F.sum("micro_cer"), F.lit(len(DEGRADED)))
    a = metrics.where(F.col("scenario").isin(*DEGRADED)).agg(mean.alias("degraded_macro_cer"))
    b = baseline.where(F.col("scenario").isin(*DEGRADED)).agg(mean.alias("_base"))
    return a.join(F.broadcast(b), F.lit(True)).select("degraded_macro_cer", (F.col("degraded_macro_cer") - F.col("_base")).alias("macro_delta"))


def improved(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: how many degraded scenarios are below the baseline."""
    base = baseline.select("scenario", F.col("micro_cer").alias("_base"))
    return metrics.where(F.col("scenario").isin(*DEGRADED)).join(base, "scenario").agg(F.count_if(F.col("micro_cer") < F.col("_base")).alias("improved"))


def dpo_violations(metrics: DataFrame, parent: DataFrame, base: DataFrame, gate: dict[str, float], preference: DataFrame) -> DataFrame:
    """The SFT gate against the parent, the clean cap against the base, and preference.

    `preference(accuracy, pairs)`: accuracy above a half and at least the floor, pairs enough.
    """
    out = sft_violations(metrics, parent, {**gate, "clean_cer_increase_vs_base_max": 1.0})
    b = base.where("scenario = 'clean'").select(F.col("micro_cer").alias("_b"))
    clean = metrics.where("scenario = 'clean'").join(F.broadcast(b), F.lit(True)).withColumn("_d", F.col("micro_cer") - F.col("_b"))
    out = out.unionByName(_named(clean, F.col("_d") > gate["clean_cer_increase_vs_base_max"], "clean_increase_vs_base", F.lit("clean"), F.col("_d")))
    acc = F.col("accuracy")
    out = out.unionByName(_named(preference, ~((acc >= gate["min_preference_accuracy"]) & (acc > 0.5)), "preference_accuracy", F.lit("preference"), acc))
    return out.unionByName(_named(preference, F.col("pairs") < gate["min_val_pairs"], "val_pairs", F.lit("preference"), F.col("pairs")))


def rl_violations(metrics: DataFrame, parent: DataFrame, base: DataFrame, gate: dict[str, float], run: DataFrame) -> DataFrame:
    """The DPO gate without preference, and `run(step0_reward, reward, raw_kl, reference_matched)`."""
    never = metrics.sparkSession.createDataFrame([(1.0, int(gate["min_val_pairs"]))], "accuracy double, pairs long")
    out = dpo_violations(metrics, parent, base, gate, never)
    kl, d = F.col("raw_kl"), F.col("reward") - F.col("step0_reward")
    out = out.unionByName(_named(run, ~F.col("reference_matched"), "reference_changed", F.lit("run"), F.lit(1.0)))
    out = out.unionByName(_named(run, F.isnan(kl) | (kl > gate["raw_kl_max"]), "raw_kl", F.lit("run"), kl))
    return out.unionByName(_named(run, F.isnan(d) | (d < -gate["reward_drop_stop"]), "reward_drop", F.lit("run"), d))


def decision(violations: DataFrame, better: DataFrame, least: int) -> DataFrame:
    """One row (passed, risk_stop, risks, improved)."""
    v = violations.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.concat_ws(" ", "scope", "code"))).alias("risks"))
    return v.join(F.broadcast(better), F.lit(True)).select(((F.col("n") == 0) & (F.col("improved") >= least)).alias("passed"), (F.col("n") > 0).alias("risk_stop"), "risks", "improved")


def rl_passes(decided: DataFrame, run: DataFrame, least_gain: float) -> DataFrame:
    gain = F.col("reward") - F.col("step0_reward")
    ok = ~F.isnan(gain) & (gain >= least_gain)
    return decided.join(F.broadcast(run.select(gain.alias("reward_delta"), ok.alias("reward_passed"))), F.lit(True)).withColumn("passed", F.col("passed") & F.col("reward_passed"))


def one_decision_per_step(decisions: DataFrame) -> DataFrame:
    """Rows (step, n) of steps that don't have exactly one decision."""
    return decisions.groupBy("step").agg(F.count("*").alias("n")).where("n <> 1")


def publishable(releases: DataFrame) -> DataFrame:
    """Rows (release, problem): what keeps a release from being a parent."""
    from quillstone.functions.text import first_of, is_blank

    problem = first_of(
        (~F.col("status").eqNullSafe("published"), "not_published"), (~F.coalesce(F.col("publishable"), F.lit(False)), "not_publishable"),
        (is_blank(F.col("release")), "no_id"), (~F.coalesce(F.col("adapter_sha").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad_sha"),
    )
    return releases.select("release", problem.alias("problem")).where("problem is not null")


def checkpoint_problems(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (step, name, problem) where the files of `found(step, name, sha256)` are not the recorded ones: missing, extra, changed."""
    from quillstone.functions.text import first_of

    a = recorded.select("step", "name", F.col("sha256").alias("_a"), F.lit(True).alias("_r"))
    b = found.select("step", "name", F.col("sha256").alias("_b"), F.lit(True).alias("_f"))
    problem = first_of((F.col("_f").isNull(), "missing"), (F.col("_r").isNull(), "extra"), (~F.col("_a").eqNullSafe(F.col("_b")), "changed"))
    return a.join(b, ["step", "name"], "full_outer").select("step", "name", problem.alias("problem")).where("problem is not null")


def latest_complete(recorded: DataFrame, problems: DataFrame) -> DataFrame:
    """One row (step): the last recorded step without a problem, which a pointer may name; none if there is none."""
    good = recorded.select("step").distinct().join(problems.select("step").distinct(), "step", "left_anti")
    return good.agg(F.max("step").alias("step")).where("step is not null")


def smoke_problems(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows (sample_id, problem) where predictions are not as `expected(sample_id, fails)`: absent, failed, empty_transcript, or no_error where one must be."""
    from quillstone.functions.text import first_of, is_blank

    got = predictions.select("sample_id", F.col("error").alias("_error"), F.col("prediction_raw").alias("_said"), F.lit(True).alias("_there"))
    failed = ~is_blank(F.col("_error"))
    problem = first_of(
        (F.col("_there").isNull(), "absent"), (F.col("fails") & ~failed, "no_error"), (~F.col("fails") & failed, "failed"),
        (~F.col("fails") & is_blank(F.col("_said")), "empty_transcript"),
    )
    return expected.join(got, "sample_id", "left").select("sample_id", problem.alias("problem")).where("problem is not null")


def baseline_problems(rows: DataFrame, split: str, parent: str) -> DataFrame:
    """Rows (key, code) that keep `rows(split, parent, scenario, samples, micro_cer, manifest_sha256)` from being a pinned baseline.

    Every scenario stands once, with samples, a rate that is finite and not negative, and a digest.
    """
    from quillstone.functions.maths import finite

    checks = {
        "split": ~F.col("split").eqNullSafe(split), "parent": ~F.col("parent").eqNullSafe(parent), "scenario": ~F.coalesce(F.col("scenario").isin(*SCENARIOS), F.lit(False)),
        "samples": ~F.coalesce(F.col("samples") >= 1, F.lit(False)), "micro_cer": ~F.coalesce(finite(F.col("micro_cer")) & (F.col("micro_cer") >= 0), F.lit(False)),
        "digest": ~F.coalesce(F.col("manifest_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
    }
    each = rows.select(F.col("scenario").alias("key"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("code"))
    wanted = rows.sparkSession.createDataFrame([(s,) for s in SCENARIOS], "key string")
    n = wanted.join(rows.groupBy(F.col("scenario").alias("key")).agg(F.count("*").alias("n")), "key", "left")
    code = F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "twice")
    return each.unionByName(n.select("key", code.alias("code")).where("code is not null"))
