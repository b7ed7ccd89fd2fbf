import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import audio, maths
from quillstone.functions import sequence as S
from quillstone.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_normalize():
    assert [T.fold(x) for x in ("你好。", "你好 世界", "ABC", "Straße", "ＡＢ")] == ["你好", "你好世界", "abc", "strasse", "ab"]


def test_text_problem(spark):
    rows = [("", "empty_text"), (None, "empty_text"), ("　 ", "empty_text"), ("<|x", "text_has_prompt_marker"), ("a你", "text_has_latin"), ("12", "text_not_chinese"), ("你好", None)]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", T.text_problem(F.col("t")))
    assert all(r.got == r.want for r in df.collect())


def test_clean_transcript(spark):
    rows = [
        ("<sil>", None, "silence_interval"), ("你好/overlap", None, "overlap_tag"), ("<#>`", None, "empty_after_tag_strip"), ("<|你好", None, "forbidden_prompt_token"),
        ("你好a", None, "contains_latin_code_switch"), ("12", None, "no_cjk_char"), ("你。", None, "empty_or_too_short_text"), (" 你<%> 好 ", "你好", None),
    ]
    df = spark.createDataFrame(rows, "t string, text string, reason string").withColumn("got", T.clean_transcript(F.col("t")))
    for r in df.collect():
        assert (r.got.text, r.got.reason) == (r.text, r.reason)


def test_ids_and_paths(spark):
    got = one(
        spark, meeting=T.meeting_id(F.lit("R1_M2_x")), alone=T.meeting_id(F.lit("R1")), spk=T.speaker_token(F.lit("a_spk12_b")), none=T.speaker_token(F.lit("x")), utt=T.utterance_speaker(F.lit("BAC009S0002W0122")),
        ok=T.is_safe_path(F.lit("a/b.wav")), up=T.is_safe_path(F.lit("a/../b")), root=T.is_safe_path(F.lit("/a")), back=T.is_safe_path(F.lit("a\\b")),
        said=T.generation_text(F.lit("language X<asr_text> 你<asr_text>好<|im_end|> ")), stop=T.stop_reason(F.array(F.lit(1), F.lit(9)), 9, 5),
        iv=T.interval_id(F.lit("m"), F.lit("s"), F.lit(1.234), F.lit(2.0)), step=T.step_name(F.lit(7)),
    )
    assert got == {
        "meeting": "R1_M2", "alone": "R1", "spk": "SPK12", "none": None, "utt": "S0002", "ok": True, "up": False, "root": False, "back": False,
        "said": "你<asr_text>好", "stop": "eos", "iv": "alimeeting_m_s_0000123_0000200", "step": "step_000007",
    }


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_is_least_and_rebuilds_both_sides():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(9))) for _ in range(2))
        ops = S.align(a, b)
        assert sum(o != "match" for o, _, _ in ops) == slow_distance(a, b)
        assert "".join(a[i] for o, i, _ in ops if o != "insert") == a and "".join(b[j] for o, _, j in ops if o != "delete") == b
    assert [o for o, _, _ in S.align("xy", "yx")] == ["substitute", "substitute"]


def test_gap_insertions_and_strip(spark):
    digits = "0123456789"
    rows = [(digits, digits[:5] + "X" * 30 + digits[5:], 30), (digits, digits + "X" * 30, 0), (digits, "X" * 30 + digits, 0)]
    df = spark.createDataFrame(rows, "a string, b string, want int").withColumn("n", S.gap_insertions(S.align_chars("a", "b"), F.length("a")))
    assert all(r.n == r.want for r in df.collect())
    long = "0123456789ABCDEFGHIJ"
    got = spark.createDataFrame([(long, long[:8] + long[12:])], "a string, b string").select(S.strip_gap("a", "b").alias("x")).first().x
    assert got.chosen == got.rejected == long[:8] + long[12:]


def test_flags(spark):
    rows = [("啊啊啊啊", True), ("你好你好你好", True), ("我们的目的", False), ("啊啊", False), ("", False)]
    df = spark.createDataFrame(rows, "t string, want boolean").withColumn("got", S.is_repeated(F.col("t")))
    assert all(r.got == r.want for r in df.collect())
    assert one(spark, a=S.is_long(F.lit(1), F.lit(2)), b=S.is_long(F.lit(2), F.lit(3))) == {"a": True, "b": False}


def test_score_rows(spark):
    rows = [("你好", "你号", None, "eos"), ("你好", "你好", "boom", "length")]
    df = spark.createDataFrame(rows, "r string, p string, e string, s string")
    a, b = df.select(*[c.alias(n) for n, c in S.scored(*[F.col(x) for x in "rpes"]).items()]).collect()
    assert (a.edit_count, a.reference_char_count, a.sample_cer, a.valid_output) == (1, 2, 0.5, True)
    assert (b.edit_count, b.empty_output, b.valid_output, b.truncated, b.inference_error) == (2, False, False, True, True)
    with pytest.raises(Exception, match="empty reference"):
        spark.createDataFrame([("。", "x", None, None)], "r string, p string, e string, s string").select(S.scored(*[F.col(x) for x in "rpes"])["edit_count"]).collect()


def test_arrays(spark):
    ints = lambda *x: F.array(*[F.lit(v) for v in x])
    got = one(spark, h=S.hamming(F.lit("abc"), F.lit("axc")), u=S.hamming(F.lit("a"), F.lit("ab")), m=S.mismatch_mask(ints(1, 2), ints(1, 3)), s=S.mismatch_mask(ints(1, 2), ints(1, 2)),
              l=S.label_mask(ints(5, 6, 7, 8), F.lit(1), ints(1, 1, 1, 0)), t=S.shifted_labels(ints(-100, 6, 7, -100)))
    assert got == {"h": 1, "u": None, "m": [False, True], "s": [True, True], "l": [-100, 6, 7, -100], "t": [6, 7]}


def test_maths(spark):
    got = one(
        spark, z=maths.neg_log_sigmoid(F.lit(0.0)), big=maths.neg_log_sigmoid(F.lit(-800.0)), exact=maths.reward(F.lit(0.0), F.lit(False), F.lit(False)), empty=maths.reward(F.lit(1.0), F.lit(True), F.lit(False)),
        low=maths.reward(F.lit(4.0), F.lit(False), F.lit(True)), k=maths.k3(F.array(F.lit(-1.0)), F.array(F.lit(-1.0))), ms=maths.duration_ms(F.lit(0.0025)), nan=maths.duration_ms(F.lit(float("nan"))),
        lr0=maths.lr_multiplier(F.lit(0), 2, 10), lr=maths.lr_multiplier(F.lit(1), 2, 10), end=maths.lr_multiplier(F.lit(10), 2, 10, 0.1),
    )
    assert got["z"] == pytest.approx(math.log(2)) and got["big"] == pytest.approx(800)
    assert (got["exact"], got["empty"], got["low"], got["k"], got["ms"], got["nan"], got["lr0"], got["lr"], got["end"]) == (1.0, -0.5, -1.0, 0.0, 2, None, 0.0, 0.5, 0.1)
    with pytest.raises(Exception, match="not finite"):
        one(spark, x=maths.neg_log_sigmoid(F.lit(float("inf"))))


def test_audio(spark):
    x = np.sin(np.arange(1600) / 10).astype(np.float32) * 0.5
    assert len(audio.mono_16k(np.stack([x, x], axis=1), 8000)) == 3200
    y = audio.noise(x, 10.0, 3)
    assert (y == audio.noise(x, 10.0, 3)).all() and 8 < 10 * np.log10(np.mean(x**2) / np.mean((y - x) ** 2)) < 12
    assert (audio.dropout(x, 0.4, 0.1)[640:800] == 0).all() and audio.reverb(x, 10, 0.5, 2).shape == x.shape
    with pytest.raises(ValueError):
        audio.noise(np.zeros(5, np.float32), 10, 1)
    src = spark.createDataFrame([("a", x.tolist()), ("b", [0.0, 0.0])], "source_id string, samples array<float>")
    got = audio.render(src, {"noise": {"snr_db": 10.0}, "reverb": {"delay_ms": 1, "decay": 0.5, "repeats": 1}, "far_field": {"lowpass_window": 3, "gain": 0.5}, "dropout": {"start_ratio": 0.4, "width_ratio": 0.1}}, 1)
    assert {(r.source_id, r.scenario) for r in got.where("reason is not null").collect()} == {("b", "noise")} and got.count() == 10
    cut = one(spark, s=F.size(audio.slice_by_time(F.array_repeat(F.lit(0.5), 100), F.lit(0.001), F.lit(0.002))), p=audio.quality_problem(F.array(F.lit(0.1)), 0.2, 0.0), e=audio.quality_problem(F.array().cast("array<double>"), 0.2, 0.0))
    assert cut == {"s": 16, "p": "low_peak", "e": "empty"}


def test_segmentation_by_a_locked_dictionary(spark, tmp_path):
    import hashlib

    from quillstone.functions import segment as G

    path = tmp_path / "words.txt"
    path.write_text("中国 50 n\n国人 20\n中国人 40\n人 30\n中 5\n国 5\n你好 10\n", "utf-8")
    sha = hashlib.sha256(path.read_bytes()).hexdigest()
    words = G.load_dictionary(str(path), "1.0", sha, "1.0")
    assert G.segment("中国人你好abc12 国人", words) == ["中国人", "你好", "abc12", "国人"]
    assert G.segment("", words) == [] and G.segment("无x人", words) == ["无", "x", "人"]
    for version, digest in (("2.0", sha), ("1.0", "0" * 64)):
        with pytest.raises(G.LockError):
            G.load_dictionary(str(path), version, digest, "1.0")
    rows = spark.createDataFrame([(1, "中国人"), (2, None), (3, "")], "id long, text string")
    assert {r.id: r.words for r in G.segmented(rows, "text", "words", words).collect()} == {1: ["中国人"], 2: None, 3: []}


def test_silence_tags_in_any_number(spark):
    rows = [("sil " * 50_000, False), ("<SIL>(sil)<_> <space>" * 20_000, False), ("<sil " * 3, True), ("sil " * 50_000 + "x", True), ("  sil ", False), ("", False), (None, False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("want", T.is_active_speech(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_bound_values_and_clean_transcript_on_edges(spark):
    df = spark.createDataFrame([("好" * 100_000,), ("",), (None,), ("<sil>" * 30_000 + "你好",)], "t string")
    got = [(r.c.reason, None if r.c.text is None else len(r.c.text)) for r in df.select(T.clean_transcript(F.col("t")).alias("c")).collect()]
    assert got == [(None, 100_000), ("silence_interval", None), ("silence_interval", None), (None, 2)]
    fast = [(r.c.reason, None if r.c.text is None else len(r.c.text)) for r in df.select(T.clean_transcript(F.col("t"), norm=T.normalize_fast).alias("c")).collect()]
    assert fast == got
    assert [r.x for r in df.select(T.bound(F.length("t"), lambda n: n + n).alias("x")).collect()] == [200_000, 0, None, 300_004]


def test_word_scores_equal_plain_distances(spark):
    draw = random.Random(3)
    rows = [([draw.choice(["to", "too", "be"]) for _ in range(draw.randrange(1, 8))], [draw.choice(["to", "too", "be"]) for _ in range(draw.randrange(8))], i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "r array<string>, p array<string>, failed boolean")
    got = df.select("r", "p", "failed", *[c.alias(n) for n, c in S.word_scored(F.col("r"), F.col("p"), F.col("failed")).items()]).collect()
    for x in got:
        want = slow_distance(x.r, [] if x.failed else x.p)
        assert (x.word_edit_count, x.reference_word_count, x.sample_wer) == (want, len(x.r), want / len(x.r))


def test_short_cuts_of_text_rules_agree_with_the_whole_patterns(spark):
    draw = random.Random(6)
    pieces = ["sil", "SIL", "ſil", "<sil>", "(Sil)", "<space>", "<_>", "(", ">", "s", "e", " ", "\n", "\t", "　", "\x85", "\x1c", "你", "K", "x", "< %\n>", "(~)", "<$>", "&", "`", "/OverLap", "<ASR_text>", "<|"]
    rows = [(None,), ("",)] + [("".join(draw.choice(pieces[: draw.choice((13, 20, 28))]) for _ in range(draw.randrange(1, 7))),) for _ in range(3000)]
    t = F.col("t")
    squeezed = F.regexp_replace(t, r"(?U)\s+", "")
    blank = t.isNull() | (squeezed == "")
    bare = F.regexp_replace(t, r"(?i)<sil>|<\s*%\s*>|<->|<\$>|<#>|<_>|<space>|\(~\)|\(sil\)|`|&", "")
    pairs = [
        (T.squeeze(t), squeezed), (T.is_blank(t), blank), (F.regexp_replace(t, T.ANNOTATION, ""), bare),
        (T.is_active_speech(t), ~blank & (F.regexp_replace(T.strip(t), T.SILENCE_MARK, "") != "")),
        (T.has_folded(t, "/overlap"), F.contains(F.lower(t), F.lit("/overlap"))), (T.normalize_fast(t), F.regexp_replace(F.replace(F.lower(t), F.lit("ß"), F.lit("ss")), r"[\p{P}\p{Z}\p{Cc}]", "")),
        (T.clean_transcript(t, norm=T.normalize_fast), T.clean_transcript(t, norm=lambda x: T.normalize_fast(x))),
    ]
    df = spark.createDataFrame(rows, "t string")
    assert df.where(~F.forall(F.array(*[a.eqNullSafe(b) for a, b in pairs]), lambda same: same)).collect() == []


def test_a_transcript_is_stripped_once_and_normalised_last(spark):
    df = spark.createDataFrame([("x",)], "t string").select(T.clean_transcript(F.col("t"), norm=T.normalize_fast).alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.ANNOTATION) == 1 and plan.count("\\p{Cc}") == 1
