"""Contracts of what a training run takes in: parameter names, pinned metrics, pair metadata, smoke subsets, leaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.hashing import keyed
from quillstone.operators.aggregates import split_intersections
from quillstone.operators.joins import ContractError
from quillstone.operators.windows import top_k_per_group
from quillstone.sources import variants

#: The projections that train, by the end of a module's name, and the parts of a name that rule it out.
PROJECTION = r"thinker\.model\.layers\.[0-9]+\.self_attn\.(q_proj|k_proj|v_proj|o_proj)"
OTHER_PARTS = ("audio_tower", "embed_tokens", "lm_head", "projector")


def decoder_attention(name: Column) -> Column:
    """Whether a module is an attention projection of the text decoder; null for a null name."""
    return name.rlike(rf"(^|\.){PROJECTION}$") & ~name.rlike("|".join(OTHER_PARTS))


def trainable(name: Column) -> Column:
    """Whether a parameter is a low-rank weight on such a projection; null for a null name."""
    return name.rlike(rf"(^|\.){PROJECTION}\.lora_[AB](\.default)?\.weight$")


def trainable_problems(rows: DataFrame, name: str = "name") -> DataFrame:
    """Rows (name, problem): `outside` for every parameter that must not train, `none` if no parameter may."""
    ok = F.coalesce(trainable(F.col(name)), F.lit(False))
    outside = rows.where(~ok).select(F.col(name).alias("name"), F.lit("outside").alias("problem"))
    none = rows.agg(F.count_if(ok).alias("_n")).where("_n = 0").select(F.lit(None).cast("string").alias("name"), F.lit("none").alias("problem"))
    return outside.unionByName(none)


def metrics_schema(version: str, split: str, parent: str, extra: Sequence[tuple] = ()) -> list[tuple]:
    """The closed schema of a pinned metrics document, for `variants.schema_problems`; `extra` are more paths of the same form."""
    rows = [
        ("schema_version", "string", True, None, None, version), ("split", "string", True, None, None, split), ("parent", "string", True, None, None, parent),
        ("samples", "integer", True, 1.0, None, None), ("by_scenario", "object", True, None, None, None),
    ]
    for s in T.SCENARIOS:
        rows += [(f"by_scenario.{s}", "object", True, None, None, None), (f"by_scenario.{s}.samples", "integer", True, 1.0, None, None), (f"by_scenario.{s}.micro_cer", "number", True, 0.0, None, None)]
    return rows + list(extra)


def metrics_problems(documents: DataFrame, key: str, text: str, schema: Sequence[tuple]) -> DataFrame:
    """Rows (key, path, problem) of JSON metrics that are not what a gate may be pinned to; see `variants.schema_problems`."""
    return variants.schema_problems(variants.leaves(documents, key, text), key, schema)


def pair_metadata_problems(rows: DataFrame, strip_schema: str, launch: str, gap_strip: str, done: str = "pairs_gap_stripped") -> DataFrame:
    """Rows (key, problem): the first thing that keeps pair metadata from matching its configuration and release.

    `rows(key, payload, config, release)` hold maps of strings. Metadata of `strip_schema` are of gap-stripped pairs: they need the
    launch words, their status, a flag that they are not trainable, the option, the seed and four digests of the configuration, and
    may name no release but the parent. Other metadata name the parent, its adapter's digest and the digests of both pair files.
    A null map counts as empty but for the payload, which is no_object.
    """
    p, c, r = (lambda k, m=m: F.try_element_at(F.coalesce(F.col(m), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.lit(k)) for m in ("payload", "config", "release"))
    other = lambda a, b: ~a.eqNullSafe(b)
    pins = [(f"{prefix}{part}_pairs_sha256", f"{prefix}null_{part}_pairs_sha256") for prefix in ("", "source_") for part in ("train", "val")]
    strip = T.first_of(
        (other(c("launch_utterance"), F.lit(launch)), "launch"), (other(p("status"), F.lit(done)), "status"), (other(p("trainable"), F.lit("false")), "trainable"),
        (other(p("gap_strip"), F.lit(gap_strip)), "gap_strip"), (other(p("seed"), c("seed")), "seed"),
        *[(other(p(left), c(right)), left) for left, right in pins],
        (p("release_id").isNotNull() & other(p("release_id"), c("parent_release")), "release_id"),
    )
    plain = T.first_of(
        (other(p("release_id"), c("parent_release")), "release_id"), (other(p("adapter_sha256"), r("adapter_sha256")), "adapter_sha256"),
        *[(other(p(left), c(right)), left) for left, right in pins[:2]],
    )
    problem = F.when(F.col("payload").isNull(), "no_object").when(p("schema_version").eqNullSafe(F.lit(strip_schema)), strip).otherwise(plain)
    return rows.select("key", problem.alias("problem")).where("problem is not null")


def untouched_audit(rows: DataFrame, disposition: str = "unlistened") -> DataFrame:
    """Rows (key, problem) of audits `rows(key, status, by_scenario)` that claim more than `disposition`.

    `by_scenario` maps a scenario to its disposition. Problems: status, no_scenarios, and disposition_<scenario> for each one.
    """
    status = rows.where(F.col("status").isNotNull() & (F.col("status") != disposition)).select("key", F.lit("status").alias("problem"))
    none = rows.where("by_scenario is null").select("key", F.lit("no_scenarios").alias("problem"))
    each = rows.select("key", F.explode("by_scenario").alias("_s", "_d")).where(~F.col("_d").eqNullSafe(disposition))
    return status.unionByName(none).unionByName(each.select("key", F.concat(F.lit("disposition_"), "_s").alias("problem")))


def _whole_sources(rows: DataFrame) -> DataFrame:
    """(split, source_id, n, distinct) of sources; whole ones have every scenario once."""
    known = F.col("scenario").isin(*T.SCENARIOS)
    return rows.groupBy("split", "source_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(known, F.col("scenario"))).alias("kinds"), F.count_distinct("scenario").alias("named"))


def _chosen(per: DataFrame, seed: int, wanted: Mapping[str, tuple[str, int]]) -> DataFrame:
    whole = per.where((F.col("kinds") == len(T.SCENARIOS)) & (F.col("n") == len(T.SCENARIOS)))
    out = None
    for split, (label, k) in wanted.items():
        part = top_k_per_group(whole.where(F.col("split") == split).select("split", "source_id"), ["split"], keyed(seed, F.col("source_id"), label), k, "source_id")
        out = part if out is None else out.unionByName(part)
    return out


def smoke_subset_problems(rows: DataFrame, seed: int, wanted: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Rows (key, problem) that keep `rows(split, source_id, scenario)` from giving a smoke subset.

    `wanted` maps a split to its rank's label and how many sources it takes. Problems: no_source (a row without source or of an
    unknown scenario; the key is its split), duplicate_scenario (of a source in a split), few_sources (a split has fewer whole sources
    than wanted; the key is the split) and overlap (a source chosen in two splits).
    """
    rows = rows.where(F.col("split").isin(*wanted))
    bad = rows.where(F.col("source_id").isNull() | ~F.coalesce(F.col("scenario").isin(*T.SCENARIOS), F.lit(False)))
    out = bad.select(F.col("split").alias("key"), F.lit("no_source").alias("problem")).distinct()
    per = _whole_sources(rows.where("source_id is not null and scenario is not null"))
    out = out.unionByName(per.where(F.col("n") > F.col("named")).select(F.concat_ws("/", "split", "source_id").alias("key"), F.lit("duplicate_scenario").alias("problem")))
    chosen = _chosen(per, seed, wanted)
    names = rows.sparkSession.createDataFrame([(s, k) for s, (_, k) in wanted.items()], "split string, k int")
    few = names.join(chosen.groupBy("split").agg(F.count("*").alias("n")), "split", "left").where("coalesce(n, 0) < k")
    out = out.unionByName(few.select(F.col("split").alias("key"), F.lit("few_sources").alias("problem")))
    return out.unionByName(split_intersections(chosen, "source_id").select(F.col("source_id").alias("key"), F.lit("overlap").alias("problem")))


def smoke_subset(rows: DataFrame, seed: int, wanted: Mapping[str, tuple[str, int]]) -> DataFrame:
    """The rows of the chosen sources with their position from 1; raises ContractError where `smoke_subset_problems` finds any."""
    bad = smoke_subset_problems(rows, seed, wanted)
    if not bad.isEmpty():
        raise ContractError("no smoke subset", bad)
    return rows.join(F.broadcast(_chosen(_whole_sources(rows), seed, wanted)), ["split", "source_id"])


def pair_source_problems(rows: DataFrame) -> DataFrame:
    """Rows (key, problem) of `rows(split, source_id, audio, wav_problem)` that pairs must not be built from.

    leak_source and leak_audio for keys of several splits, duplicate_audio for one that a split has more than once,
    audio_<wav_problem> for files that are unsound, no_source and no_audio (the key is the split) for nulls.
    """
    out = rows.where("wav_problem is not null").select(F.col("audio").alias("key"), F.concat(F.lit("audio_"), "wav_problem").alias("problem")).distinct()
    again = rows.where("audio is not null").groupBy("split", "audio").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(again.select(F.concat_ws("/", "split", "audio").alias("key"), F.lit("duplicate_audio").alias("problem")))
    for column, name in (("source_id", "source"), ("audio", "audio")):
        out = out.unionByName(rows.where(F.col(column).isNull()).select(F.col("split").alias("key"), F.lit(f"no_{name}").alias("problem")).distinct())
        out = out.unionByName(split_intersections(rows, column).select(F.col(column).alias("key"), F.lit(f"leak_{name}").alias("problem")))
    return out


def paired_clusters(manifest: DataFrame, a: DataFrame, b: DataFrame, edits: str, refs: str, scopes: Sequence[str]) -> DataFrame:
    """Rows (scope, cluster, a, b, refs): what a paired bootstrap of two stages resamples.

    `manifest(sample_id, source_id)` names each sample's cluster; scored rows of both stages (sample_id, scenario, `edits`, `refs`)
    meet it by sample. Scope `overall` has all samples, every other one those that stage `a` gives its scenario. A cluster is in every
    scope, with zeros where it has no sample. A sample of the manifest that either stage lacks or repeats raises; others are passed over.
    """
    once = lambda df, name: df.groupBy("sample_id").agg(
        F.count("*").alias(f"_{name}n"), F.first("scenario").alias(f"_{name}s"), F.first(edits).alias(f"_{name}"), F.first(refs).alias(f"_{name}r")
    )
    met = manifest.select("sample_id", "source_id").join(once(a, "a"), "sample_id", "left").join(once(b, "b"), "sample_id", "left")
    sound = (F.col("_an") == 1) & (F.col("_bn") == 1)
    value = lambda c: F.when(sound, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("stages don't have one row of sample "), F.col("sample_id"))))
    names = ["overall", *scopes]
    met = met.select(F.col("source_id").alias("cluster"), F.col("_as").alias("_s"), value("_a").alias("_a"), F.col("_b"), F.col("_ar").alias("_r"))
    take = lambda scope, c: F.sum(F.col(c) if scope == "overall" else F.when(F.col("_s") == scope, F.col(c)))
    cells = [F.struct(F.lit(s).alias("scope"), *[F.coalesce(take(s, c), F.lit(0)).cast("long").alias(n) for c, n in (("_a", "a"), ("_b", "b"), ("_r", "refs"))]).alias(f"_{i}") for i, s in enumerate(names)]
    wide = met.groupBy("cluster").agg(*cells)
    return wide.select("cluster", F.explode(F.array(*[f"_{i}" for i in range(len(names))])).alias("_c")).select("_c.scope", "cluster", "_c.a", "_c.b", "_c.refs")


def manifest_lines(rows: DataFrame, version: str, settings: Mapping[str, Mapping[str, object]], processor: str) -> DataFrame:
    """Rows (sample_id, line): manifest rows as JSON, optional members only where they have a value.

    `rows(sample_id, source_id, text, scenario, split)` may have speaker_id, official_split, source_package and seed. Rows of every
    scenario but clean have an augmentation: its type, the processor's version, that scenario's settings, and the seed for noise.
    """
    optional = [F.col(c) for c in ("speaker_id", "official_split", "source_package") if c in rows.columns]
    names = sorted({k for s in settings.values() for k in s})
    seed = F.col("seed").cast("long") if "seed" in rows.columns else F.lit(None).cast("long")

    def setting(name: str) -> Column:
        out = F.lit(None)
        for scenario, values in settings.items():
            if name in values:
                out = F.when(F.col("scenario") == scenario, F.lit(values[name])).otherwise(out)
        return out.alias(name)

    record = F.struct(F.col("scenario").alias("type"), F.lit(processor).alias("processor_version"), *[setting(n) for n in names], F.when(F.col("scenario") == "noise", seed).alias("seed"))
    line = F.struct(
        F.lit(version).alias("schema_version"), "sample_id", F.col("source_id").alias("source_utterance_id"), F.concat(F.lit("wavs/"), "sample_id", F.lit(".wav")).alias("audio"),
        "text", F.lit("zh").alias("language"), "scenario", "split", *optional, F.when(F.col("scenario") != "clean", record).alias("augmentation"),
    )
    return rows.select("sample_id", F.to_json(line).alias("line"))


def smoke_manifest(clean: DataFrame, version: str, noise: str, snr_db: float, seed: int) -> DataFrame:
    """Rows (sample_id, fails, line): a smoke manifest's three rows of each row of `clean(source_id, text)`.

    The clean one, a noisy one, and one whose file is missing on purpose, so that a run must report it (`fails`).
    """
    one = lambda name, scenario, file, fails, **more: F.struct(
        F.concat("source_id", F.lit(name)).alias("sample_id"), F.lit(fails).alias("fails"), F.lit(scenario).alias("scenario"), F.concat(F.lit("wavs/"), *file, F.lit(".wav")).alias("audio"),
        (F.struct(F.lit(more.get("type")).alias("type"), F.lit(more.get("snr_db")).cast("double").alias("snr_db"), F.lit(more.get("seed")).cast("long").alias("seed"), F.lit(noise).alias("version")) if more else F.lit(None)).alias("augmentation"),
    )
    forms = F.array(
        one("-clean", "clean", [F.col("source_id")], False),
        one("-noise", "noise", [F.col("source_id"), F.lit("_noise")], False, type="gaussian_noise", snr_db=snr_db, seed=seed),
        one("-missing", "dropout", [F.lit("does_not_exist")], True, type="missing_file"),
    )
    rows = clean.select("source_id", "text", F.explode(forms).alias("f"))
    line = F.struct(
        F.lit(version).alias("schema_version"), "f.sample_id", F.col("source_id").alias("source_utterance_id"), "f.audio", "text", F.lit("zh").alias("language"), "f.scenario",
        F.lit("smoke").alias("split"), "f.augmentation",
    )
    return rows.select("f.sample_id", "f.fails", F.to_json(line).alias("line"))


def report_lines(metrics: DataFrame, stages: Sequence[str], scenarios: Sequence[str]) -> DataFrame:
    """Rows (section, place, line): the table rows of a report on `metrics(stage, scenario, edit_count, micro_cer)` of each stage and scenario.

    Section 1 has a line a stage: edits over all scenarios, the change against the first stage and the one before, and the mean rate of the
    scenarios but clean. Section 2 has a line a scenario: edits and rate of each stage, the last one's change against the first and the one before.
    """
    rows = metrics.where(F.col("stage").isin(*stages) & F.col("scenario").isin(*scenarios))
    at = lambda name: F.first(F.when(F.col("stage") == name, F.col("edit_count")), ignorenulls=True)
    rate = lambda name: F.first(F.when(F.col("stage") == name, F.col("micro_cer")), ignorenulls=True)
    each = rows.groupBy("scenario").agg(*[at(s).alias(f"e_{s}") for s in stages], *[rate(s).alias(f"c_{s}") for s in stages])
    shown = [F.format_string("`%d` (`%.6f`)", f"e_{s}", f"c_{s}") for s in stages]
    last, before, first = (F.col(f"e_{stages[i]}") for i in (-1, -2 if len(stages) > 1 else 0, 0))
    change = [F.format_string("`%+d`", last - first), F.format_string("`%+d`", last - before)]
    place = lambda names, c: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)).cast("int")
    second = each.select(F.lit(2).alias("section"), place(scenarios, "scenario").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", F.format_string("`%s`", "scenario"), *shown, *change), F.lit(" |")).alias("line"))
    whole = rows.agg(*[F.sum(F.when(F.col("stage") == s, F.col("edit_count"))).alias(f"e_{s}") for s in stages], *[F.avg(F.when((F.col("stage") == s) & (F.col("scenario") != "clean"), F.col("micro_cer"))).alias(f"c_{s}") for s in stages])
    lines = [
        F.struct(F.lit(i + 1).alias("place"), F.format_string("| `%s` | `%d` | `%+d` | `%+d` | `%.6f` |", F.lit(s.upper()), f"e_{s}", F.col(f"e_{s}") - F.col(f"e_{stages[0]}"), F.col(f"e_{s}") - F.col(f"e_{stages[max(0, i - 1)]}"), f"c_{s}").alias("line"))
        for i, s in enumerate(stages)
    ]
    first_part = whole.select(F.lit(1).alias("section"), F.explode(F.array(*lines)).alias("x")).select("section", "x.place", "x.line")
    return first_part.unionByName(second)
