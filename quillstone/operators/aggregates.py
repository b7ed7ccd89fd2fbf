"""Aggregates: scenario summaries, zero-filled counts, quantiles, preference and group statistics, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import maths
from quillstone.shared import cut

RATES = {
    "empty_rate": "empty_output", "repeated_rate": "repeated_output", "long_rate": "long_output",
    "truncation_rate": "truncated", "inference_error_rate": "inference_error", "valid_output_rate": "valid_output",
}


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def summary_columns(wer: bool = False) -> list[Column]:
    out = [
        F.count("*").alias("samples"), F.sum("edit_count").alias("edit_count"), F.sum("reference_char_count").alias("reference_char_count"),
        ratio(F.sum("edit_count"), F.sum("reference_char_count")).alias("micro_cer"), F.avg("sample_cer").alias("macro_cer"),
        *[F.avg(F.col(c).cast("double")).alias(r) for r, c in RATES.items()],
    ]
    if wer:
        out += [
            F.sum("word_edit_count").alias("word_edit_count"), F.sum("reference_word_count").alias("reference_word_count"),
            ratio(F.sum("word_edit_count"), F.sum("reference_word_count")).alias("micro_wer"), F.avg("sample_wer").alias("macro_wer"),
        ]
    return out


def scenario_of(column: str = "scenario") -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))


def scenario_summary(scored: DataFrame, wer: bool = False) -> DataFrame:
    """Micro and macro error and output rates of each scenario."""
    return scored.groupBy(scenario_of().alias("scenario")).agg(*summary_columns(wer))


def overall_and_scenarios(scored: DataFrame, wer: bool = False) -> DataFrame:
    """As `scenario_summary`, with a row "overall", in one pass over the rows."""
    rows = scored.withColumn("scenario", scenario_of())
    out = rows.groupingSets([[], [F.col("scenario")]], F.col("scenario")).agg(F.grouping("scenario").alias("_all"), *summary_columns(wer))
    return out.withColumn("scenario", F.when(F.col("_all") == 1, "overall").otherwise(F.col("scenario"))).drop("_all")


def zero_filled(rows: DataFrame, dims: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates by `keys` with a row of zeros for each combination of `dims` that has none."""
    got = rows.groupBy(*keys).agg(*aggs)
    out = dims.join(got, list(keys), "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in got.columns if c not in keys])


def dimension(spark, **values: Sequence[str]) -> DataFrame:
    """All combinations of a few named values; small by what it is given."""
    import itertools

    rows = list(itertools.product(*values.values()))
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in values))


def duration_range(rows: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(x).alias("minimum"), F.percentile(x, 0.5).alias("median"), F.max(x).alias("maximum"))


def nearest_rank(rows: DataFrame, x: str, qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Columns q<percent>: the element at the even-rounded place q * (n - 1) of the sorted values.

    Values are counted, dealt by range and numbered range by range, so no task orders a whole
    group; the places that are asked for are then looked up in their ranges.
    """
    from quillstone.operators.windows import running_sum

    vals = rows.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_x")).agg(F.count("*").alias("_n"))
    placed = running_sum(vals, [*keys, "_x"], "_n", "_before")
    # places are counted over all groups: a group's first is the least of its own
    sizes = placed.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(F.sum("_n").alias("_all"), F.min("_before").alias("_first"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    at = F.col("_before") - F.col("_first")
    place = lambda q: F.rint(q * (F.col("_all") - 1))
    hit = lambda q: F.max(F.when((at <= place(q)) & (place(q) < at + F.col("_n")), F.col("_x")))
    return placed.join(sizes, on).groupBy(*keys).agg(*[F.round(hit(q), 4).alias(f"q{round(100 * q)}") for q in qs])


def degraded_macro(summary: DataFrame, names: Sequence[str] = ("dropout", "far_field", "noise", "reverb")) -> DataFrame:
    """Unweighted mean of the degraded scenarios' micro rates and the sum of their edits."""
    return summary.where(F.col("scenario").isin(*names)).agg(
        ratio(F.sum("micro_cer"), F.lit(len(names))).alias("degraded_macro_cer"), F.sum("edit_count").alias("degraded_edits")
    )


def breakdown(scored: DataFrame, group: str, scenarios: Sequence[str]) -> DataFrame:
    """Edits and micro rate by group and scenario, every scenario present, 0.0 where nothing is counted."""
    groups = scored.select(group).distinct()
    dims = groups.select(group, F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario"))
    got = zero_filled(scored, dims, [group, "scenario"], F.count("*").alias("samples"), F.sum("edit_count").alias("edit_count"), F.sum("reference_char_count").alias("reference_char_count"))
    return got.withColumn("micro_cer", F.coalesce(ratio(F.col("edit_count"), F.col("reference_char_count")), F.lit(0.0)))


def pair_summary(manifest: DataFrame, pairs: DataFrame, dims: DataFrame) -> DataFrame:
    """By scenario: manifest rows, pairs, their sources, retention and mean length differences (null without pairs)."""
    rows = manifest.groupBy("scenario").agg(F.count("*").alias("manifest_rows"))
    got = pairs.groupBy("scenario").agg(
        F.count("*").alias("pairs"), F.count_distinct("source_id").alias("sources"), F.avg(F.col("char_length_delta").cast("double")).alias("mean_char_delta"),
        F.avg((F.col("rejected_token_count") - F.col("chosen_token_count")).cast("double")).alias("mean_token_delta"),
    )
    out = dims.join(rows, "scenario", "left").join(got, "scenario", "left")
    n, m = F.coalesce("pairs", F.lit(0)), F.coalesce("manifest_rows", F.lit(0))
    return out.select("scenario", m.alias("manifest_rows"), n.alias("pairs"), F.coalesce("sources", F.lit(0)).alias("sources"), ratio(n, m).alias("retention"), "mean_char_delta", "mean_token_delta")


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def preference_accuracy(pairs: DataFrame, delta: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs, wins, ties and (wins + ties / 2) / pairs."""
    d = F.col(delta)
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.count_if(d > 0).alias("positive"), F.count_if(d == 0).alias("ties"),
        ratio(F.count_if(d > 0) + 0.5 * F.count_if(d == 0), F.count("*")).alias("accuracy"),
    )


def raw_preference(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("chosen_logp") > F.col("rejected_logp")).cast("double")).alias("raw_policy_accuracy"))


def dpo_loss(pairs: DataFrame, delta: str) -> DataFrame:
    return pairs.agg(F.avg(maths.neg_log_sigmoid(F.col(delta))).alias("loss"))


def length_buckets(pairs: DataFrame, spark) -> DataFrame:
    """Raw accuracy where the rejected text is shorter, as long, or longer; 0.0 in an empty bucket."""
    d = F.col("char_length_delta")
    name = F.when(d < 0, "shorter_rejected").when(d == 0, "equal_length").otherwise("longer_rejected")
    dims = dimension(spark, bucket=("shorter_rejected", "equal_length", "longer_rejected"))
    got = zero_filled(pairs.withColumn("bucket", name), dims, ["bucket"], F.count("*").alias("pairs"), F.count_if(F.col("chosen_logp") > F.col("rejected_logp")).alias("wins"))
    return got.select("bucket", "pairs", F.coalesce(ratio(F.col("wins"), F.col("pairs")), F.lit(0.0)).alias("raw_policy_accuracy"))


def group_advantages(candidates: DataFrame, group: str, value: str = "reward") -> DataFrame:
    """`candidates` with advantage (value less the group's mean) and zero_advantage (all values equal, advantage 0)."""
    stats = candidates.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias("_mean"), (F.min(value) == F.max(value)).alias("zero_advantage"))
    out = candidates.join(stats, F.col(group) == F.col("_g"))
    return out.withColumn("advantage", F.when(F.col("zero_advantage"), 0.0).otherwise(F.col(value) - F.col("_mean"))).drop("_g", "_mean")


def group_validity(candidates: DataFrame, group: str) -> DataFrame:
    """(group, valid, reasons): valid if every candidate stopped at the end id without error."""
    why = F.when(F.col("error").isNotNull() & (F.trim("error") != ""), F.lit("error")).when(~F.col("stop_reason").eqNullSafe("eos"), F.concat(F.lit("stop_"), F.coalesce("stop_reason", F.lit("none"))))
    return candidates.groupBy(group).agg(F.every(why.isNull()).alias("valid"), F.array_sort(F.collect_set(why)).alias("reasons"))


def group_loss(candidates: DataFrame, group: str, beta: float) -> DataFrame:
    """Mean over a group of -advantage * mean log-prob + beta * mean k3; all 0 where every advantage is 0."""
    pg = -F.col("advantage") * maths.mean(F.col("policy_logp"))
    k3 = maths.k3(F.col("policy_logp"), F.col("reference_logp"))
    got = candidates.groupBy(group).agg(F.every(F.col("advantage") == 0).alias("zero_advantage"), F.avg(pg).alias("_p"), F.avg(k3).alias("_k"))
    zero = lambda c: F.when(F.col("zero_advantage"), 0.0).otherwise(c)
    return got.select(group, "zero_advantage", zero(F.col("_p")).alias("policy_loss"), zero(beta * F.col("_k")).alias("kl_loss"), zero(F.col("_p") + beta * F.col("_k")).alias("group_loss"), zero(F.col("_k")).alias("k3_proxy_mean"))


def window_summary(groups: DataFrame, window: str) -> DataFrame:
    """By accumulation window: valid, invalid, signal and zero groups, whether it steps, and the loss over valid ones."""
    ok, zero = F.col("valid"), F.col("zero_advantage")
    return groups.groupBy(window).agg(
        F.count_if(ok).alias("valid_groups"), F.count_if(~ok).alias("invalid_groups"), F.count_if(ok & ~zero).alias("signal_groups"),
        F.count_if(ok & zero).alias("zero_groups"), (F.count_if(ok & ~zero) > 0).alias("steps"), F.avg(F.when(ok, F.col("group_loss"))).alias("loss"),
    )


def flat_summary(summary: DataFrame, stage: str, scenarios: Sequence[str], values: Sequence[str], gap: tuple[str, str] | None = None, of: str = "micro_cer") -> DataFrame:
    """One row a stage with a column <scenario>_<value> for each, null where a scenario is absent, and
    `gap`: the value `of` the first scenario of the pair less that of the second."""
    cell = lambda s, v: F.max(F.when(F.col("scenario") == s, F.col(v)))
    out = [cell(s, v).alias(f"{s}_{v}") for s in scenarios for v in values]
    if gap is not None:
        out.append((cell(gap[0], of) - cell(gap[1], of)).alias("gap"))
    return summary.groupBy(stage).agg(*out)


def token_weighted(rows: DataFrame, total: str, n: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of totals over sum of counts, never a mean of means; 0.0 without tokens."""
    return rows.groupBy(*keys).agg(F.coalesce(ratio(F.sum(total), F.sum(n)), F.lit(0.0)).alias("value"), F.sum(n).alias("tokens"))


def dropout_signature(rows: DataFrame, dropout_delta: float, clean_delta: float, gap_least: int = 30, early_clean: float = 0.005, early_ratio: float = 0.75, quiet: float = 0.002) -> DataFrame:
    """One row: gap insertions, length ratio and the failure's name, of `rows(gap_insertions, hyp_chars, ref_chars)`."""
    got = rows.agg(F.sum("gap_insertions").alias("gap_insertions"), ratio(F.sum("hyp_chars"), F.sum("ref_chars")).alias("length_ratio"))
    gap, early = F.col("gap_insertions") >= gap_least, F.lit(clean_delta > early_clean) | (F.col("length_ratio") < early_ratio)
    name = F.when(gap & early, "MIXED").when(gap, "GAP_INSERT").when(early, "EARLY_DELETE").when(F.lit(abs(dropout_delta) < quiet), "QUIET").otherwise("OTHER")
    return got.withColumn("signature", name)


def split_intersections(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Rows (key, splits): keys that occur in more than one split."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def decode_stops(rows: DataFrame, ids: str, cap: int) -> DataFrame:
    return rows.agg(F.avg(F.size(ids).cast("double")).alias("mean_tokens"), F.max(F.size(ids)).alias("max_tokens"), F.count_if(F.size(ids) >= cap).alias("at_cap"))


def cluster_sums(rows: DataFrame, cluster: str, edits: Sequence[str], refs: str) -> DataFrame:
    """Per cluster: what the bootstrap resamples."""
    return rows.groupBy(cluster).agg(*[F.sum(c).alias(c) for c in edits], F.sum(refs).alias(refs))


SLICE = 1 << 18


def generator_slice(seed: int, number: int, n: int) -> np.ndarray:
    """The integers below n (at most 2^32) that slice `number` of SLICE 32-bit outputs of NumPy's generator gives.

    `default_rng(seed).integers(0, n)` takes 32-bit halves of PCG64's outputs, the lower first, multiplies
    each by n and keeps the upper half of the product, unless the lower half is one of the 2^32 mod n
    smallest, when the output is passed over. PCG64 jumps ahead, so any slice is made on its own.
    """
    generator = np.random.PCG64(seed).advance(number * SLICE // 2)
    halves = generator.random_raw(SLICE // 2).astype("<u8").view("<u4").astype(np.uint64)
    product = halves * np.uint64(n)
    return (product >> np.uint64(32))[(product & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)].astype(np.int64)


def bootstrap_numpy(sums: DataFrame, comparison: str, cluster: str, a: str, b: str, refs: str, draws: int = 2000, seed: int = 42, held: int = 1_000_000) -> DataFrame:
    """(comparison, delta, low, high): the ratio b - a over refs, at least one, and its 2.5 and 97.5 percentiles.

    Clusters are resampled as `default_rng(seed).integers(0, n, (draws, n))` does, in cluster order, in
    many tasks: the generator's outputs are cut into slices, each made by jumping ahead. What a
    slice accepts is counted first, as an output that is passed over moves all later ones. Up to `held` clusters in all, their
    sums are sent to the tasks; of more, picks are counted and joined to them.
    """
    from quillstone.operators.windows import global_index

    placed = global_index(sums.select(comparison, cluster, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), F.col(refs).cast("double").alias("_r")), [comparison, cluster], "_g")
    sizes = placed.groupBy(comparison).agg(F.count("*").alias("_n"), F.min("_g").alias("_first"), ratio(F.sum("_b") - F.sum("_a"), F.greatest(F.sum("_r"), F.lit(1.0))).alias("delta"))
    sizes = cut(sizes.withColumn("_wanted", F.col("_n") * draws))
    placed = cut(placed.join(sizes.select(comparison, "_first"), comparison).withColumn("_i", F.col("_g") - F.col("_first")).drop("_g", "_first"))
    # room for what is passed over: at worst every second output, in fact one in 2^32 / n
    share = (F.lit(1 << 32) - F.lit(1 << 32) % F.col("_n")) / F.lit(float(1 << 32))
    slices = F.ceil(F.col("_wanted") / share / SLICE * 1.05) + 1
    todo = sizes.select(comparison, "_n", "_wanted", F.explode(F.sequence(F.lit(0).cast("long"), slices.cast("long"))).alias("_s"))
    todo = todo.repartition(comparison, "_s")
    kind = dict(sums.dtypes)[comparison]

    def accepted(batches):
        for pdf in batches:
            yield pdf.assign(_k=[len(generator_slice(seed, int(s), int(n))) for s, n in zip(pdf["_s"], pdf["_n"])])

    counted = todo.mapInPandas(accepted, f"{comparison} {kind}, _n long, _wanted long, _s long, _k long")
    # one row a slice
    before = Window.partitionBy(comparison).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut(counted.withColumn("_at", F.coalesce(F.sum("_k").over(before), F.lit(0))))
    short = counted.groupBy(comparison, "_wanted").agg(F.sum("_k").alias("_have")).where(F.col("_have") < F.col("_wanted"))
    if not short.isEmpty():
        raise ValueError("more outputs were passed over than there was room for")
    used = counted.where(F.col("_at") < F.col("_wanted")).repartition(comparison, "_s")
    few = placed.count() <= held
    spark = sums.sparkSession
    shared = None
    if few:
        table = placed.select(comparison, "_i", (F.col("_b") - F.col("_a")).alias("_d"), "_r").orderBy(comparison, "_i").toPandas()
        shared = spark.sparkContext.broadcast({k: (g["_d"].to_numpy(), g["_r"].to_numpy()) for k, g in table.groupby(comparison)})

    def picks(pdf: pd.DataFrame):
        for key, n, wanted, s, at in zip(pdf[comparison], pdf["_n"], pdf["_wanted"], pdf["_s"], pdf["_at"]):
            n, at = int(n), int(at)
            index = generator_slice(seed, int(s), n)[: int(wanted) - at]
            yield key, n, (at + np.arange(len(index))) // n, index

    def summed(batches):
        for pdf in batches:
            for key, _, draw, index in picks(pdf):
                d, r = shared.value[key]
                low = int(draw[0]) if len(draw) else 0
                yield pd.DataFrame({comparison: key, "_draw": np.arange(low, int(draw[-1]) + 1), "_d": np.bincount(draw - low, d[index]), "_rs": np.bincount(draw - low, r[index])})

    def listed(batches):
        for pdf in batches:
            for key, n, draw, index in picks(pdf):
                at, m = np.unique(draw * n + index, return_counts=True)
                yield pd.DataFrame({comparison: key, "_draw": at // n, "_i": at % n, "_m": m})

    if few:
        sums_of = used.mapInPandas(summed, f"{comparison} {kind}, _draw long, _d double, _rs double")
    else:
        met = used.mapInPandas(listed, f"{comparison} {kind}, _draw long, _i long, _m long").join(placed, [comparison, "_i"])
        sums_of = met.select(comparison, "_draw", (F.col("_m") * (F.col("_b") - F.col("_a"))).alias("_d"), (F.col("_m") * F.col("_r")).alias("_rs"))
    deltas = sums_of.groupBy(comparison, "_draw").agg((F.sum("_d") / F.greatest(F.sum("_rs"), F.lit(1.0))).alias("_x"))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = np.percentile(pdf["_x"].to_numpy(), [2.5, 97.5])
        return pd.DataFrame({comparison: [pdf[comparison].iloc[0]], "low": [low], "high": [high]})

    # `draws` rows each
    limits = deltas.groupBy(comparison).applyInPandas(ends, f"{comparison} {kind}, low double, high double")
    return sizes.select(comparison, "delta").join(limits, comparison)


def bootstrap_hashed(sums: DataFrame, cluster: str, a: str, b: str, refs: str, draws: int = 200, seed: int = 42) -> DataFrame:
    """(draw, delta) for each draw: clusters resampled by a hash instead of a generator.

    Draw d's i-th pick is the cluster at index hash(seed, d, i) mod n, so a pick depends on
    nothing but its place, and picks are counted before they meet the clusters.
    """
    from quillstone.functions.hashing import keyed, unsigned
    from quillstone.operators.windows import global_index

    placed = global_index(sums, [cluster], "_i").withColumn("_i", F.col("_i") - 1)
    n = placed.count()
    spark = sums.sparkSession
    picks = spark.range(draws * n).select((F.col("id") / n).cast("long").alias("draw"), (F.col("id") % n).alias("_p"))
    index = (unsigned(keyed(seed, F.col("draw").cast("string"), F.col("_p").cast("string")), 8) % n).cast("long")
    counted = picks.groupBy("draw", index.alias("_i")).agg(F.count("*").alias("_m"))
    met = counted.join(placed, "_i")
    return met.groupBy("draw").agg(ratio(F.sum(F.col("_m") * (F.col(b) - F.col(a))), F.sum(F.col("_m") * F.col(refs))).alias("delta"))
