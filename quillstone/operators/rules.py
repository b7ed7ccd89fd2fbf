"""Rules between fields of a configuration, as data: which must hold, when others do."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources import variants


@dataclass(frozen=True)
class Rule:
    """`path` must be one of `values` (text; NULL for null or absent), or, where it has a value, differ from the path in `other`, where all guards of `when` hold and none of `unless`."""

    name: str
    path: str
    values: tuple[str, ...] = ()
    when: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    other: str | None = None


@dataclass(frozen=True)
class RuleSet:
    """Guards are conjunctions of (path, value); defaults stand for absent paths."""

    rules: tuple[Rule, ...]
    guards: dict[str, dict[str, str]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)


NULL = "NULL"


def frozen(prefix: str, table: dict[str, str], **guards) -> tuple[Rule, ...]:
    """A rule for each path that must have the value of a frozen table."""
    return tuple(Rule(f"{prefix}:{path}", path, (value,), **guards) for path, value in table.items())


def violations(found: DataFrame, key: str, rules: RuleSet) -> DataFrame:
    """Rows (key, rule, path) of `leaves(key, path, kind, value, number)` that break a rule; see `violations_in`."""
    found = variants.together(found, key).where(F.exists("leaves", lambda x: (x["path"] == "$") & (x["kind"] == "object")))
    at = lambda p: F.get(F.filter("leaves", lambda x: x["path"] == p), F.lit(0))["value"]
    texts = [at(p) for p in _asked(rules)]
    return _judged(found.select(key, F.array(*texts).alias("_texts")), key, rules)


def violations_in(configs: DataFrame, key: str, text: str, rules: RuleSet) -> DataFrame:
    """Rows (key, rule, path) of JSON documents that break a rule, each judged in its own row, with no shuffle.

    Numbers are compared as doubles, everything else as text (arrays as their JSON, objects as absent);
    documents that are malformed, or no objects, are not judged.
    """
    at = {p: "$" + "".join(f"['{part}']" for part in p.split(".")) for p in _asked(rules)}
    is_object = F.col(text).rlike(r"^[ \t\r\n]*\{")
    v = F.when(is_object, F.try_parse_json(F.col(text)))
    rows = configs.select(key, v.alias("_v")).select(key, "_v", F.array(*[F.try_variant_get("_v", p, "string") for p in at.values()]).alias("_texts"))
    # a text that begins like an object may be a string's: only then is its value looked at again
    is_object = lambda t, p: t.startswith("{") & F.schema_of_variant(F.try_variant_get("_v", p, "variant")).startswith("OBJECT")
    texts = F.zip_with("_texts", F.array(*map(F.lit, at.values())), lambda t, p: F.when(is_object(t, p), None).otherwise(t))
    return _judged(rows.where("_v is not null").select(key, texts.alias("_texts")), key, rules)


def _asked(rules: RuleSet) -> list[str]:
    return sorted({p for g in rules.guards.values() for p in g} | {r.path for r in rules.rules} | {r.other for r in rules.rules if r.other})


def _judged(rows: DataFrame, key: str, rules: RuleSet) -> DataFrame:
    """Rows (key, rule, path) of documents (key, _texts), which have a text or null for each asked path."""
    # a failing cast costs an exception, so only what begins like a number is tried
    number = lambda x: F.when(x.rlike(r"^[\x00- ]*[-+]?(?:[.0-9]|(?i:inf|nan))"), x.try_cast("double"))
    plain = lambda x: F.coalesce(number(x).cast("string"), x)
    asked = _asked(rules)
    preset = F.array(*[plain(F.lit(rules.defaults.get(p, NULL))) for p in asked])
    rows = rows.select(key, F.zip_with("_texts", preset, lambda t, d: F.coalesce(plain(t), d)).alias("_have"))
    number_of = {p: F.lit(i) for i, p in enumerate(asked)}
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    guards = [F.struct(F.lit(n).alias("guard"), F.array(*[F.struct(number_of[p].alias("at"), plain(F.lit(v)).alias("want")) for p, v in g.items()]).alias("all")) for n, g in rules.guards.items()]
    holds = lambda g: F.forall(g["all"], lambda c: F.get("_have", c["at"]) == c["want"])
    held = F.transform(F.filter(F.array(*guards), holds), lambda g: g["guard"]) if guards else texts(())
    table = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.path).alias("path"), number_of[r.path].alias("at"), number_of.get(r.other, F.lit(None).cast("int")).alias("other"),
            F.array(*[plain(F.lit(v)) for v in r.values]).cast("array<string>").alias("allowed"), texts(r.when).alias("need"), texts(r.unless).alias("bar"),
        ) for r in rules.rules
    ])

    def broken(r):
        text = F.get("_have", r["at"])
        same = (text == F.get("_have", r["other"])) & (text != NULL)
        bad = F.when(r["other"].isNotNull(), same).otherwise(~F.array_contains(r["allowed"], text))
        return F.forall(r["need"], lambda g: F.array_contains("_held", g)) & ~F.exists(r["bar"], lambda g: F.array_contains("_held", g)) & bad

    found = F.filter(table, broken)
    return rows.select(key, "_have", held.alias("_held")).select(key, F.inline(F.transform(found, lambda r: F.struct(r["rule"].alias("rule"), r["path"].alias("path")))))


def duck_violations(docs: str, rules: RuleSet) -> str:
    """The same as DuckDB SQL; `docs` begins a WITH and ends in a relation `docs(id, doc)` of JSON text."""
    q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(q, xs)) + "]::VARCHAR[]"
    preset = lambda p: q(rules.defaults.get(p, NULL))
    guards = ", ".join(f"({q(n)}, {q(p)}, {q(v)}, {preset(p)})" for n, g in rules.guards.items() for p, v in g.items())
    table = ", ".join(f"({q(r.name)}, {q(r.path)}, {listed(r.values)}, {listed(r.when)}, {listed(r.unless)}, {q(r.other)}, {preset(r.path)})" for r in rules.rules)
    return f"""{docs}, guards(guard, path, want, preset) AS (VALUES {guards}), rules(rule, path, allowed, need, bar, other, preset) AS (VALUES {table}),
met AS (SELECT id, guard, want AS a, coalesce(json_extract_string(doc, '$.' || path), preset) AS b FROM docs, guards),
held AS (SELECT id, list(guard) AS held FROM (SELECT id, guard FROM met GROUP BY id, guard HAVING bool_and(coalesce(try_cast(a AS DOUBLE) = try_cast(b AS DOUBLE), a = b))) GROUP BY id),
judged AS (SELECT id, rule, path, allowed, other, coalesce(json_extract_string(doc, '$.' || path), preset) AS a, coalesce(json_extract_string(doc, '$.' || other), 'NULL') AS o
  FROM docs LEFT JOIN held USING (id), rules
  WHERE len(list_filter(need, lambda g: NOT list_contains(coalesce(held, []), g))) = 0 AND NOT list_has_any(coalesce(held, []), bar))
SELECT id, rule, path FROM judged WHERE CASE WHEN other IS NOT NULL THEN a = o AND a <> 'NULL'
  ELSE len(list_filter(allowed, lambda x: coalesce(try_cast(x AS DOUBLE) = try_cast(a AS DOUBLE), x = a))) = 0 END"""


# The frozen tables and the rules between fields of the stages' profiles.
RL_COMMON = {
    "lora.dropout": "0", "batch.micro_batch_size": "1", "train.save_steps": "5", "train.eval_steps": "5", "rl.updates_per_rollout": "1",
    "rl.invalid_group_rate_max": "0.01",
}
RL_ALIGNED = {
    "optim.learning_rate": "1e-06", "batch.gradient_accumulation_steps": "4", "train.max_steps": "20", "train.max_epochs": "1", "runtime.max_runtime_minutes": "120",
    "rl.kl_beta": "0.10", "rl.max_group_visits": "1000", "rl.no_signal_stop_groups": "100", "optim.scheduler_max_steps": "50",
}
RL_PLAIN = {
    "optim.learning_rate": "1e-05", "batch.gradient_accumulation_steps": "2", "rl.kl_beta": "0.04", "rl.no_signal_stop_groups": "20", "rl.max_group_visits": "500",
    "optim.scheduler_max_steps": NULL, "rl.train_scenarios": NULL, "rl.loss_token_scope": "sequence", "rl.max_edit_count": NULL,
    "rl.accumulate_signal_groups_only": "false", "rl.dropout_anchor_weight": "0",
}
DPO_COMMON = {
    "lora.dropout": "0", "batch.gradient_accumulation_steps": "4", "train.max_epochs": "1", "train.save_steps": "10", "train.eval_steps": "10", "dpo.beta": "0.1",
    "runtime.max_runtime_minutes": "120",
}
DPO_PROBE = {
    "optim.learning_rate": "5e-05", "batch.micro_batch_size": "1", "train.max_steps": "10", "train.keep_last": "1", "optim.warmup_steps": "0",
    "optim.scheduler_max_steps": NULL, "dpo.train_scenarios": '["dropout"]',
}
NON_DROPOUT = '["clean","noise","reverb","far_field"]'
DEGRADED = '["noise","reverb","far_field"]'


def rl_rules(parent: str) -> RuleSet:
    """The budget of the RL stage, whose parent release is `parent`, of step 40."""
    aligned = {
        "profile": "pilot", "rl.train_scenarios": DEGRADED, "rl.loss_token_scope": "mismatched_only", "rl.max_edit_count": "2",
        "rl.accumulate_signal_groups_only": "true", "rl.dropout_anchor_weight": "0.05",
    }
    rules = (
        Rule("profile", "profile", ("smoke", "pilot")), *frozen("common", RL_COMMON), *frozen("aligned", RL_ALIGNED, when=("aligned",)),
        *frozen("plain", RL_PLAIN, unless=("aligned",)),
        *frozen("pilot", {"train.max_steps": "50", "train.max_epochs": "1", "runtime.max_runtime_minutes": "120"}, when=("pilot",), unless=("aligned",)),
        *frozen("smoke", {"train.max_steps": "6", "train.max_epochs": "100", "runtime.max_runtime_minutes": "30"}, when=("smoke",)),
        *frozen("parent", {"model.parent_release": parent, "rl.parent.release_id": parent, "rl.parent.source_step": "40"}),
    )
    return RuleSet(rules, {"aligned": aligned, "pilot": {"profile": "pilot"}, "smoke": {"profile": "smoke"}}, {"rl.dropout_anchor_weight": "0"})


def dpo_rules(parent: str) -> RuleSet:
    """The budgets of the DPO stage's pilot and dropout probe, whose parent release is `parent`, of step 30."""
    pilot, probe = {"when": ("pilot",)}, {"when": ("probe",)}
    stop40 = {
        "train.max_steps": "40", "dpo.dropout_anchor_weight": "0.05", "dpo.dropout_anchor_target": "rejected_text", "dpo.loss_token_scope": "mismatched_only",
        "optim.warmup_steps": "10",
    }
    differ = tuple(
        Rule(f"differ:{a}", f"dpo.{a}_pairs_sha256", when=("probe",), unless=("unlaunched",), other=f"dpo.{b}_pairs_sha256")
        for a, b in (("null_train", "source_null_train"), ("null_val", "source_null_val"), ("filled_train", "null_train"), ("filled_val", "null_val"))
    )
    rules = (
        *frozen("pilot", DPO_COMMON | {"optim.learning_rate": "5e-06"}, **pilot), *frozen("probe", DPO_COMMON | DPO_PROBE, **probe),
        Rule("pilot:max_steps", "train.max_steps", ("100",), ("pilot",), ("stop40",)),
        Rule("pilot:scheduler", "optim.scheduler_max_steps", (NULL,), ("pilot",), ("stop40",)),
        Rule("stop40:scheduler", "optim.scheduler_max_steps", (NULL, "100"), ("pilot", "stop40")),
        Rule("pilot:train_scenarios", "dpo.train_scenarios", (NULL, NON_DROPOUT, DEGRADED), ("pilot",)),
        Rule("pilot:val_scenarios", "dpo.val_scenarios", (NULL, NON_DROPOUT), ("pilot",)),
        Rule("pilot:clean_identical", "dpo.train_scenarios", (DEGRADED,), ("pilot", "excludes_clean")),
        Rule("pilot:launch", "dpo.launch_utterance", (NULL, ""), ("pilot",)), *differ,
        *(Rule(f"parent:{p}", p, (v,), (w,)) for w in ("pilot", "probe") for p, v in (("model.parent_release", parent), ("dpo.parent.release_id", parent), ("dpo.parent.source_step", "30"))),
    )
    guards = {
        "pilot": {"profile": "pilot"}, "probe": {"profile": "dropout_probe"}, "stop40": stop40, "excludes_clean": {"dpo.exclude_clean_identical_rejected": "true"},
        "unlaunched": {"dpo.launch_utterance": NULL},
    }
    return RuleSet(rules, guards, {"dpo.dropout_anchor_weight": "0"})


# The closed schemas of the data and inference configurations.
DATA_SCHEMA = (
    ("schema_version", "string", True, None, None, None), ("seed", "integer", True, None, None, None), ("source_version", "string", True, None, None, None),
    ("audited", "boolean", True, None, None, None), ("audio_processor_version", "string", True, None, None, None), ("language", "string", True, None, None, "zh"),
    ("sample_rate", "integer", True, 16000.0, 16000.0, None), ("duration_seconds", "object", True, None, None, None), ("duration_seconds.min", "number", True, 0.0, None, None),
    ("duration_seconds.max", "number", True, 0.0, None, None), ("splits", "object", True, None, None, None), ("splits.val", "number", True, 0.0, 1.0, None),
    ("splits.test", "number", True, 0.0, 1.0, None), ("quota", "object", True, None, None, None), ("quota.min_val_rows_per_scenario", "integer", True, 1.0, None, None),
    ("scenarios", "array", True, None, None, '["clean","noise","reverb","far_field","dropout"]'), ("augmentation", "object", True, None, None, None),
)
INFER_SCHEMA = (
    ("schema_version", "string", True, None, None, None), ("seed", "integer", True, 0.0, None, None), ("model", "object", True, None, None, None), ("model.name", "string", True, None, None, None),
    ("model.revision", "string|null", False, None, None, None), ("scoring", "object", True, None, None, None), ("scoring.normalization", "string", True, None, None, "zh-cer-v1"),
    ("scoring.wer_tokenizer", "string|null", False, None, None, None), ("scoring.wer_tokenizer_version", "string|null", False, None, None, None),
    ("scoring.wer_dictionary_sha256", "string|null", False, None, None, None), ("scoring.wer_hmm", "boolean", False, None, None, None), ("decode", "object", True, None, None, None),
    ("decode.eval", "object", True, None, None, None), ("decode.eval.do_sample", "boolean", True, None, None, "false"), ("decode.eval.num_beams", "integer", True, 1.0, 1.0, None),
    ("decode.eval.max_new_tokens", "integer", True, 1.0, None, None), ("decode.eval.repetition_penalty", "number", True, None, None, None),
    ("decode.eval.no_repeat_ngram_size", "integer", True, 0.0, None, None), ("decode.eval.context", "string", True, None, None, None), ("decode.eval.language", "string", True, None, None, "zh"),
    ("decode.eval.eos_policy", "string", True, None, None, "tokenizer_eos_only"),
)
