import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import segment, tokenizing
from quillstone.functions.text import SCENARIOS
from quillstone.operators import aggregates as A
from quillstone.operators import contracts as C
from quillstone.operators.joins import ContractError


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_parameter_names(spark):
    base = "thinker.model.layers.3.self_attn.q_proj"
    names = [base, f"m.{base}", f"x{base}", f"audio_tower.{base}", f"{base}.lora_A.weight", f"m.{base}.lora_B.default.weight", f"{base}.lora_C.weight", "q_proj", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.a, r.t) for r in rows.select("name", C.decoder_attention(F.col("name")).alias("a"), C.trainable(F.col("name")).alias("t")).collect()}
    assert [n for n in names if (got[n][0] or False)] == [base, f"m.{base}"]
    assert [n for n in names if (got[n][1] or False)] == [f"{base}.lora_A.weight", f"m.{base}.lora_B.default.weight"]
    assert got[None] == (None, None)
    problems = C.trainable_problems(rows)
    assert problems.count() == 8 and {r.problem for r in problems.collect()} == {"outside"}
    assert found(C.trainable_problems(rows.limit(0))) == [(None, "none")]


def test_metrics_are_closed(spark):
    good = {"schema_version": "m1", "split": "val", "parent": "sft", "samples": 5, "release_id": "r", "by_scenario": {s: {"samples": 1, "micro_cer": 0.5} for s in SCENARIOS}}
    schema = C.metrics_schema("m1", "val", "sft", [("release_id", "string", True, None, None, None)])
    bad = json.loads(json.dumps(good)) | {"samples": 0, "note": 1}
    bad["by_scenario"]["odd"] = {}
    del bad["by_scenario"]["noise"]["micro_cer"], bad["release_id"]
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "no json"), (4, None)], "key int, doc string")
    assert found(C.metrics_problems(rows, "key", "doc", schema)) == [
        (2, "by_scenario.noise.micro_cer", "missing"), (2, "by_scenario.odd", "unknown"), (2, "note", "unknown"), (2, "release_id", "missing"), (2, "samples", "range"), (3, "$", "malformed"), (4, "$", "malformed"),
    ]
    assert C.metrics_problems(rows.limit(0), "key", "doc", schema).count() == 0


def test_pair_metadata(spark):
    config = {"launch_utterance": "go", "seed": "42", "parent_release": "p", "null_train_pairs_sha256": "t", "null_val_pairs_sha256": "v", "source_null_train_pairs_sha256": "st", "source_null_val_pairs_sha256": "sv"}
    strip = {
        "schema_version": "s1", "status": "pairs_gap_stripped", "trainable": "false", "gap_strip": "g", "seed": "42", "train_pairs_sha256": "t", "val_pairs_sha256": "v",
        "source_train_pairs_sha256": "st", "source_val_pairs_sha256": "sv",
    }
    plain = {"schema_version": "p1", "release_id": "p", "adapter_sha256": "a", "train_pairs_sha256": "t", "val_pairs_sha256": "v"}
    cases = [
        (strip, config, None), (strip | {"release_id": "p"}, config, None), (strip | {"release_id": "q"}, config, "release_id"), (strip, config | {"launch_utterance": "no"}, "launch"),
        (strip | {"seed": "1"}, config, "seed"), (strip | {"source_val_pairs_sha256": None}, config, "source_val_pairs_sha256"), (plain, config, None), (plain | {"adapter_sha256": "b"}, config, "adapter_sha256"),
        ({}, config, "release_id"), (None, config, "no_object"), (strip, None, "launch"),
    ]
    rows = spark.createDataFrame([(i, p, c, {"adapter_sha256": "a"}) for i, (p, c, _) in enumerate(cases)], "key int, payload map<string,string>, config map<string,string>, release map<string,string>")
    assert found(C.pair_metadata_problems(rows, "s1", "go", "g")) == sorted([(i, w) for i, (_, _, w) in enumerate(cases) if w], key=repr)


def test_untouched_audit(spark):
    rows = spark.createDataFrame([(1, None, {"noise": "unlistened"}), (2, "passed", {"noise": "listened", "clean": None}), (3, "unlistened", None)], "key int, status string, by_scenario map<string,string>")
    assert found(C.untouched_audit(rows)) == [(2, "disposition_clean"), (2, "disposition_noise"), (2, "status"), (3, "no_scenarios")]


def test_smoke_subset(spark):
    whole = [(split, f"{split}{i}", s) for split, n in (("train", 4), ("val", 3)) for i in range(n) for s in SCENARIOS]
    shape = "split string, source_id string, scenario string"
    wanted = {"train": ("a", 2), "val": ("b", 2)}
    got = C.smoke_subset(spark.createDataFrame(whole, shape), 42, wanted)
    assert got.count() == 20 and got.select("split", "source_id").distinct().count() == 4
    broken = whole + [("val", "train0", s) for s in SCENARIOS] + [("train", "train1", "noise"), ("val", None, "clean"), ("val", "x", None), ("other", None, None)]
    rows = spark.createDataFrame(broken, shape)
    wanted = {"train": ("a", 4), "val": ("b", 4)}
    assert found(C.smoke_subset_problems(rows, 42, wanted)) == [("train", "few_sources"), ("train/train1", "duplicate_scenario"), ("train0", "overlap"), ("val", "no_source")]
    with pytest.raises(ContractError):
        C.smoke_subset(rows, 42, wanted)
    assert found(C.smoke_subset_problems(rows.limit(0), 42, wanted)) == [("train", "few_sources"), ("val", "few_sources")]


def test_pair_sources(spark):
    rows = spark.createDataFrame([("train", "a", "1", None), ("val", "a", "2", None), ("train", "b", "1", "short"), ("val", "c", "1", None), ("val", None, None, None)], "split string, source_id string, audio string, wav_problem string")
    assert found(C.pair_source_problems(rows)) == [("1", "audio_short"), ("1", "leak_audio"), ("a", "leak_source"), ("train/1", "duplicate_audio"), ("val", "no_audio"), ("val", "no_source")]


def test_two_stages_by_cluster(spark):
    manifest = spark.createDataFrame([(f"s{i}", f"c{i // 3}") for i in range(9)], "sample_id string, source_id string")
    stage = lambda n: spark.createDataFrame([(f"s{i}", "near" if i < 4 else "far", i * n % 5, 10 + i) for i in range(10)], "sample_id string, scenario string, e long, r long")
    got = C.paired_clusters(manifest, stage(1), stage(3), "e", "r", ["near", "far"])
    want = []
    for scope, inside in (("overall", range(9)), ("near", range(4)), ("far", range(4, 9))):
        for c in range(3):
            part = [i for i in inside if i // 3 == c]
            want.append((scope, f"c{c}", sum(i % 5 for i in part), sum(i * 3 % 5 for i in part), sum(10 + i for i in part)))
    assert found(got) == sorted(want, key=repr)
    interval = {r.scope: (r.delta, r.low, r.high) for r in A.bootstrap_numpy(got, "scope", "cluster", "a", "b", "refs", draws=300).collect()}
    index = np.random.default_rng(42).integers(0, 3, (300, 3))
    for scope in ("overall", "near", "far"):
        a, b, refs = (np.array([w[k] for w in want if w[0] == scope], float) for k in (2, 3, 4))
        draws = (b - a)[index].sum(1) / np.maximum(refs[index].sum(1), 1)
        assert interval[scope] == pytest.approx(((b - a).sum() / refs.sum(), *np.percentile(draws, [2.5, 97.5])))
    with pytest.raises(Exception, match="s3"):
        C.paired_clusters(manifest, stage(1).where("sample_id <> 's3'"), stage(3), "e", "r", ["near"]).collect()


def test_lines(spark):
    rows = spark.createDataFrame([("a__clean", "a", 'x "y"', "clean", "train", None, 1), ("a__noise", "a", None, "noise", "val", "S1", 7)], "sample_id string, source_id string, text string, scenario string, split string, speaker_id string, seed int")
    lines = {r.sample_id: json.loads(r.line) for r in C.manifest_lines(rows, "v1", {"noise": {"snr_db": 5.0}, "reverb": {"rt60": 0.5}}, "p1").collect()}
    assert lines["a__clean"] == {"schema_version": "v1", "sample_id": "a__clean", "source_utterance_id": "a", "audio": "wavs/a__clean.wav", "text": 'x "y"', "language": "zh", "scenario": "clean", "split": "train"}
    assert lines["a__noise"]["augmentation"] == {"type": "noise", "processor_version": "p1", "snr_db": 5.0, "seed": 7} and lines["a__noise"]["speaker_id"] == "S1" and "text" not in lines["a__noise"]
    smoke = C.smoke_manifest(rows.select("source_id", "text").limit(1), "v1", "n1", 12.0, 3).collect()
    made = {r.sample_id: (r.fails, json.loads(r.line)) for r in smoke}
    assert [made[k][0] for k in ("a-clean", "a-noise", "a-missing")] == [False, False, True]
    assert "augmentation" not in made["a-clean"][1] and made["a-noise"][1]["augmentation"] == {"type": "gaussian_noise", "snr_db": 12.0, "seed": 3, "version": "n1"}
    assert made["a-missing"][1]["audio"] == "wavs/does_not_exist.wav" and made["a-missing"][1]["split"] == "smoke"


def test_report(spark):
    rows = spark.createDataFrame([("base", "clean", 4, 0.1), ("base", "noise", 6, 0.3), ("rl", "clean", 4, 0.1), ("rl", "noise", 5, 0.25)], "stage string, scenario string, edit_count long, micro_cer double")
    got = [(r.section, r.line) for r in C.report_lines(rows, ["base", "rl"], ["clean", "noise"]).orderBy("section", "place").collect()]
    assert got == [
        (1, "| `BASE` | `10` | `+0` | `+0` | `0.300000` |"), (1, "| `RL` | `9` | `-1` | `-1` | `0.250000` |"),
        (2, "| `clean` | `4` (`0.100000`) | `4` (`0.100000`) | `+0` | `+0` |"), (2, "| `noise` | `6` (`0.300000`) | `5` (`0.250000`) | `-1` | `-1` |"),
    ]


def test_dictionary_cuts_like_brute_force(spark):
    words = spark.createDataFrame([(w,) for w in ["ab", "ab", "abc", "c", "ca", "b b", "", None, "bca"]], "w string")
    d, digest = segment.dictionary_of(words, "w", "v")
    assert set(d.weights) == {"ab", "abc", "c", "ca", "bca"} and d.longest == 3 and len(digest) == 64
    with pytest.raises(ValueError):
        segment.dictionary_of(words, "w", "v", most=2)

    def worth(parts):
        return sum(d.weights.get(p, d.rare) for p in parts)

    for text in ("".join(t) for n in range(1, 7) for t in itertools.product("äbc", repeat=n)):
        n, best = len(text), None
        for cuts in itertools.product((0, 1), repeat=n - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
            parts = [text[a:b] for a, b in zip(at, at[1:])]
            if all(len(p) == 1 or p in d.weights for p in parts):
                best = max(best, worth(parts)) if best is not None else worth(parts)
        # runs of Latin letters that stand alone are joined again afterwards
        chosen = segment.segment(text, d)
        assert "".join(chosen) == text
        assert worth([p for w in chosen for p in ([w] if w in d.weights else w)]) == pytest.approx(best)


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    texts = ["", "one two  three", "ß 中 <|endoftext|>", "long " * 30_000, None]
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in tokenizing.token_counts(rows, "t", "n", path, "<|endoftext|>").collect()}
    assert got == {i: None if t is None else 1 + len(own.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    with pytest.raises(segment.LockError):
        tokenizing.token_counts(rows, "t", "n", path, "no such token")
    with pytest.raises(segment.LockError):
        tokenizing.token_counts(rows, "t", "n", path, "<|endoftext|>", sha256="0")


def test_token_counts_of_many_texts_keep_their_rows(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = [None if i % 5 == 0 else "" if i % 7 == 0 else f"word {i} <|endoftext|> \U0001f600é " * (i % 4 + 1) for i in range(3 * tokenizing.TOGETHER + 1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    plain = tokenizing._loaded(path)
    want = {i: None if t is None else 1 + len(plain.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.i: r.n for r in tokenizing.token_counts(rows, "t", "n", path, "<|endoftext|>").collect()} == want
