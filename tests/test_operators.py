import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.hashing import keyed
from quillstone.operators import aggregates as A
from quillstone.operators import gates, joins, manifest, pairs, windows
from quillstone.operators.timeline import classify_intervals, twin_rows


def test_strict_join_reports_and_raises(spark):
    left = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y"), (None, "z")], "k string, t string")
    right = spark.createDataFrame([("a", "other"), ("c", "y")], "k string, t string")
    codes = {(r.k, r.code) for r in joins.join_violations(left, right, "k", ["t"]).collect()}
    assert codes == {("a", "mismatch_t"), ("b", "duplicate_left"), ("b", "missing_right"), ("c", "extra_right"), (None, "blank_left")}
    with pytest.raises(joins.ContractError):
        joins.strict_one_to_one(left, right, "k")
    assert joins.strict_one_to_one(left.where("k = 'a'"), right.where("k = 'a'"), "k").columns == ["k", "t"]


def test_evaluate_two_rows(spark):
    from quillstone.functions import sequence as S

    rows = spark.createDataFrame([("clean", "你好", "你好"), ("noise", "你好", "你号")], "scenario string, r string, p string")
    scored = rows.withColumns(S.scored(F.col("r"), F.col("p"), F.lit(None).cast("string"), F.lit("eos")))
    got = {r.scenario: (r.micro_cer, r.macro_cer) for r in A.overall_and_scenarios(scored).collect()}
    assert got == {"overall": (0.25, 0.25), "clean": (0.0, 0.0), "noise": (0.5, 0.5)}


@pytest.mark.parametrize("seed", range(3))
def test_interval_overlap_and_band_match_against_plain_loops(spark, seed):
    draw = random.Random(seed)
    rows = [(i, f"m{draw.randrange(2)}", f"s{draw.randrange(3)}", x := draw.uniform(0, 60), x + draw.uniform(0, 9), draw.choice("ab")) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, meeting string, speaker string, xmin double, xmax double, text string")
    want = {a[0] for a in rows for b in rows if a[1] == b[1] and a[2] != b[2] and min(a[4], b[4]) - max(a[3], b[3]) > 0.3}
    assert {r.id for r in joins.interval_overlaps(df, "meeting", "speaker", 0.3).collect()} == want
    near, far = [r for r in rows if r[0] % 2], [(*r[:2], None if r[0] % 3 == 0 else r[2], *r[3:]) for r in rows if r[0] % 2 == 0]
    far_df = spark.createDataFrame(far, df.schema)
    got = {r.id: (r.matches, r.far_id) for r in joins.band_match(df.where("id % 2 = 1"), far_df, ["meeting", "text"], 4.0, 3.0).collect()}
    for n in near:
        fits = [f for f in far if f[1] == n[1] and f[5] == n[5] and f[2] in (None, n[2]) and abs(f[3] - n[3]) <= 4 and abs((f[4] - f[3]) - (n[4] - n[3])) <= 3]
        own = [f for f in fits if f[2] == n[2]] or fits
        assert got[n[0]] == (len(own), own[0][0] if len(own) == 1 else None)


def plain_round_robin(rows, target, cap, count):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    queue = {s: sorted(v, key=lambda r: r[3]) for s, v in sorted(by.items())}
    used, out, ms, moved = dict.fromkeys(queue, 0), [], 0, True
    full = lambda: (target is not None and ms >= target) or (count is not None and len(out) >= count)
    while moved and not full():
        moved = False
        for s in queue:
            if full():
                break
            while queue[s] and cap is not None and used[s] + queue[s][0][2] > cap:
                queue[s].pop(0)
            if queue[s]:
                r = queue[s].pop(0)
                out.append(r[0])
                used[s], ms, moved = used[s] + r[2], ms + r[2], True
    return out if full() else []


@pytest.mark.parametrize("target,cap,count", [(400, None, None), (300, 90, None), (None, None, 12), (None, 60, 10), (9_999_999, None, None)])
def test_round_robin(spark, target, cap, count):
    draw = random.Random(5)
    rows = [(i, f"s{draw.randrange(5)}", draw.randrange(5, 50), draw.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, speaker string, ms long, rank double")
    got = windows.round_robin(df, "speaker", "ms", ["rank"], target, cap, count).orderBy("position").collect()
    assert [r.id for r in got] == plain_round_robin(rows, target, cap, count)


def plain_stratified(rows, most):
    by = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        by.setdefault(r[1], []).append(r)
    at, out, lost, moved = dict.fromkeys(by, 0), [], [], True
    while len(out) < most and moved:
        moved = False
        for m in sorted(by):
            if len(out) >= most:
                break
            while at[m] < len(by[m]):
                r = by[m][at[m]]
                at[m] += 1
                if r[2]:
                    out.append(r[0])
                    moved = True
                    break
                lost.append(r[0])
    return out, sorted(lost)


@pytest.mark.parametrize("seed", range(6))
def test_stratified_round_robin(spark, seed):
    draw = random.Random(seed)
    rows = [(i, f"m{draw.randrange(3)}", draw.random() < 0.6, draw.random()) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, meeting string, passed boolean, rank double")
    for most in (5, 9, 50):
        taken, lost = windows.stratified_round_robin(df, "meeting", F.col("rank"), "id", most)
        assert ([r.id for r in taken.orderBy("position").collect()], sorted(r.id for r in lost.collect())) == plain_stratified(rows, most)


def test_classify_sources_counts_only_accepted_as_first(spark):
    rows = [(1, "u1", "abc", True), (2, "u1", "你好", True), (3, "u1", "你好", True), (4, "bad id", "你好", True), (5, "u2", "你好", False), (6, None, "你好", True)]
    df = spark.createDataFrame(rows, "line long, source_id string, text string, has boolean").withColumns({"language": F.lit("zh"), "audio": F.lit("a.wav")})
    got = {r.line: r.reason for r in manifest.classify_sources(df, F.col("has"), F.lit(False)).collect()}
    assert got == {1: "text_has_latin", 2: None, 3: "duplicate_source", 4: "bad_source_id", 5: "missing_audio", 6: "bad_source_id"}


def test_scenarios_and_status(spark):
    src = spark.createDataFrame([("a", "你好", "train"), ("b", "你好吗", "val")], "source_id string, text string, split string")
    rows, lost = manifest.scenario_rows(src, 1, F.when((F.col("source_id") == "b") & (F.col("scenario") == "noise"), "silent"))
    assert rows.count() == 5 and [tuple(r) for r in lost.collect()] == [("b", "silent")]
    full, _ = manifest.scenario_rows(src.withColumn("audio", F.lit("x")), 1)
    assert manifest.manifest_problems(full).isEmpty()
    assert manifest.manifest_status(manifest.manifest_problems(full), manifest.shortages(full, 1)).first().status == "passed"
    assert manifest.manifest_status(manifest.manifest_problems(full), manifest.shortages(full, 2)).first().exit_code == 3
    assert manifest.counts_by_split(full).count() == 15


def test_split_mode(spark):
    df = spark.createDataFrame([(True,), (False,)], "t boolean")
    modes = [manifest.split_mode(d, F.col("t")).first().mode for d in (df, df.where("t"), df.where("not t"))]
    assert modes == ["mixed_split_mode", "official", "hash"]


def test_nearest_rank_and_preferences(spark):
    draw = random.Random(2)
    xs = [draw.choice([1.0, 2.5, 3.0, 7.25, 9.0]) for _ in range(31)]
    got = A.nearest_rank(spark.createDataFrame([(x,) for x in xs], "x double"), "x", [0.1, 0.5, 0.9]).first()
    assert tuple(got) == tuple(sorted(xs)[round(q * 30)] for q in (0.1, 0.5, 0.9))
    tie = A.preference_accuracy(spark.createDataFrame([(0.0,), (0.0,)], "d double"), "d").first()
    assert (tie.accuracy, tie.ties) == (0.5, 2)
    b = spark.createDataFrame([(-2, -1.0, -2.0), (0, -2.0, -1.0), (3, -1.0, -2.0)], "char_length_delta long, chosen_logp double, rejected_logp double")
    assert {r.bucket: (r.pairs, r.raw_policy_accuracy) for r in A.length_buckets(b, spark).collect()} == {"shorter_rejected": (1, 1.0), "equal_length": (1, 0.0), "longer_rejected": (1, 1.0)}


def test_window_loss_and_signature(spark):
    g = spark.createDataFrame([(1, True, False, 0.8), (1, True, True, 0.0), (1, False, False, None)], "w int, valid boolean, zero_advantage boolean, group_loss double")
    r = A.window_summary(g, "w").first()
    assert (r.loss, r.valid_groups, r.invalid_groups, r.signal_groups, r.zero_groups, r.steps) == (0.4, 2, 1, 1, 1, True)
    sig = lambda gap, hyp, d, c: A.dropout_signature(spark.createDataFrame([(gap, hyp, 100)], "gap_insertions long, hyp_chars long, ref_chars long"), d, c).first().signature
    assert [sig(30, 100, 0, 0), sig(30, 74, 0, 0), sig(29, 100, 0, 0.006), sig(29, 100, 0.001, 0), sig(29, 75, 0.002, 0.005)] == ["GAP_INSERT", "MIXED", "EARLY_DELETE", "QUIET", "OTHER"]


def test_bootstrap_matches_numpy(spark):
    rows = [("c", f"s{i:02d}", float(i % 4), float(i % 3), 10.0 + i) for i in range(12)]
    got = A.bootstrap_numpy(spark.createDataFrame(rows, "k string, s string, a double, b double, refs double"), "k", "s", "a", "b", "refs", 200, 7).first()
    a, b, r = (np.array([x[j] for x in rows]) for j in (2, 3, 4))
    pick = np.random.default_rng(7).integers(0, 12, size=(200, 12))
    d = (b[pick].sum(1) - a[pick].sum(1)) / r[pick].sum(1)
    assert got.delta == pytest.approx((b.sum() - a.sum()) / r.sum()) and (got.low, got.high) == pytest.approx(tuple(np.percentile(d, [2.5, 97.5])))


def test_bootstrap_draws_in_parts_as_numpy_at_once(spark, monkeypatch):
    from quillstone.plans import benchmarks

    n, draws = 40_001, 260
    rows = spark.range(n).selectExpr("'c' AS k", "id AS s", "CAST(id % 4 AS double) AS a", "CAST(id % 3 AS double) AS b", "10.0D + id % 7 AS refs")
    got = A.bootstrap_numpy(rows, "k", "s", "a", "b", "refs", draws, 7).first()
    i = np.arange(n)
    pick = np.random.default_rng(7).integers(0, n, size=(draws, n))
    d = ((i % 3)[pick].sum(1) - (i % 4)[pick].sum(1)) / (10.0 + i % 7)[pick].sum(1)
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(d, [2.5, 97.5])))

    asked = {}
    monkeypatch.setattr(A, "bootstrap_numpy", lambda *a, draws=2000, **k: asked.update(draws=draws))
    benchmarks.bootstrap_numpy(spark, "/root/testdata/sf0.001")
    assert asked == {"draws": 2000}


def test_aligned_mask(spark):
    rows = [("g", 0, 1.0, [1, 2, 3, 9], False), ("g", 1, 0.5, [1, 5, 3, 9], False), ("g", 2, 1.0, [1, 2, 3, 9], False), ("g", 3, 0.2, [1, 2, 7, 9], False), ("g", 4, 0.1, [1, 2, 9], False), ("h", 0, 1.0, [1, 2], True)]
    df = spark.createDataFrame(rows, "group string, candidate_index int, reward double, label_ids array<int>, punctuated boolean")
    got = {r.group: r for r in pairs.aligned_mask(df, "group").collect()}
    assert (got["g"].valid, got["g"].best_index, got["g"].mismatch_index, got["g"].aligned) == (True, 0, 1, [0, 1, 2])
    assert sum(got["g"].advantages) == pytest.approx(0) and not got["h"].valid


def test_pair_filters(spark):
    rows = [("a", "clean", "你好", "你号", 1, 3, 3, 0, 1), ("a", "noise", "你好", "你号", 1, 3, 3, 0, 2), ("a", "reverb", "你好", "你吗", 1, 3, 3, 0, 3), ("b", "noise", "你好", "你好吗", 1, 3, 4, 1, 4)]
    df = spark.createDataFrame(rows, "source_id string, scenario string, chosen_text string, rejected_text string, edit_count long, chosen_token_count long, rejected_token_count long, char_length_delta long, line long")
    assert {r.line for r in pairs.filter_pairs(df, exclude_clean=True).collect()} == {3, 4}
    assert {r.line for r in pairs.filter_pairs(df, aligned_most=1).collect()} == {1, 2, 3}
    assert {r.line for r in pairs.filter_pairs(df, scenarios=["noise"], most_edits=0).collect()} == set()


def test_gates(spark):
    cols = "scenario string, samples long, micro_cer double, empty_rate double, repeated_rate double, long_rate double, truncation_rate double, valid_output_rate double"
    rows = lambda c, n: [(s, 100, v, 0.0, 0.0, 0.0, 0.0, 1.0) for s, v in {"overall": n, "clean": c, "noise": n, "reverb": n, "far_field": n, "dropout": n}.items()]
    from quillstone.plans.benchmarks import GATE

    base, good, bad = (spark.createDataFrame(rows(*x), cols) for x in ((0.05, 0.1), (0.05, 0.09), (0.08, 0.2)))
    d = gates.decision(gates.sft_violations(good, base, GATE), gates.improved(good, base), 2).first()
    assert (d.passed, d.risk_stop, d.improved) == (True, False, 4)
    codes = {r.code for r in gates.sft_violations(bad, base, GATE).collect()}
    assert codes == {"clean_increase", "clean_increase_vs_base", "scenario_increase", "macro_increase"}
    pref = spark.createDataFrame([(0.5, 10)], "accuracy double, pairs long")
    assert {r.code for r in gates.dpo_violations(good, base, base, GATE, pref).collect()} == {"preference_accuracy", "val_pairs"}
    run = spark.createDataFrame([(0.9, 0.8, 0.2, False)], "step0_reward double, reward double, raw_kl double, reference_matched boolean")
    assert {r.code for r in gates.rl_violations(good, base, base, GATE, run).collect()} == {"reference_changed", "raw_kl", "reward_drop"}


def test_intervals_end_to_end(spark):
    cols = "id long, meeting string, speaker string, xmin double, xmax double, text string"
    near = spark.createDataFrame([(1, "m", "A", 0.0, 2.0, "你好吗"), (2, "m", "B", 5.0, 7.0, "天地人"), (3, "m", "A", 6.0, 8.0, "上下左"), (4, "m", "A", 20.0, 20.1, "你好吗"), (5, "m", "A", 30.0, 32.0, "<sil>")], cols)
    far = spark.createDataFrame([(11, "m", "A", 0.1, 2.1, "你好吗")], cols)
    got = classify_intervals(near, far, 0.1, 0.5, 30.0, 0.5, 0.5)
    assert {r.id: r.reason for r in got.collect()} == {1: None, 2: "overlap", 3: "overlap", 4: "duration_out_of_range", 5: "silence_interval"}
    assert twin_rows(got.where("reason is null")).count() == 2


def test_runs_windows_and_anchors(spark):
    v = spark.createDataFrame([("r", i, z) for i, z in enumerate([1, 1, 0, 1, 1, 1])], "run string, i int, z int")
    got = windows.zero_signal_runs(v, "run", "i", F.col("z") == 1).orderBy("i").collect()
    assert [r.consecutive for r in got] == [1, 2, 0, 1, 2, 3]
    n = spark.range(7)
    assert windows.count_windows(n, ["id"], 3, keep_tail=False).count() == 6
    assert [(r.offset, r.id) for r in windows.anchor_slice(n, "id", 3, 3).orderBy("offset").collect()] == [(0, 6), (1, 0), (2, 1)]
    assert windows.top_k_per_group(n.withColumn("g", F.lit(1)), ["g"], keyed(1, F.col("id").cast("string")), 2, "id").count() == 2


def test_nearest_rank_by_group(spark):
    draw = random.Random(3)
    rows = [(k, float(draw.randrange(40))) for k in ("a", "b", None) for _ in range(draw.randrange(1, 90))]
    got = {r.k: (r.q10, r.q50, r.q95) for r in A.nearest_rank(spark.createDataFrame(rows, "k string, x double"), "x", [0.1, 0.5, 0.95], ["k"]).collect()}
    for k in ("a", "b", None):
        xs = sorted(x for g, x in rows if g == k)
        assert got[k] == tuple(xs[round(q * (len(xs) - 1))] for q in (0.1, 0.5, 0.95))


def test_attach_refuses_two_rows_of_a_key(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, m string")
    assert sorted(tuple(r) for r in joins.attach(rows, one, "k").collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="two rows of metadata: 2"):
        joins.attach(rows, one.unionByName(spark.createDataFrame([(2, "c")], "k long, m string")), "k").collect()


def test_summaries_flat_and_stored(spark):
    s = spark.createDataFrame([("base", "overall", 0.5), ("base", "clean", 0.25), ("base", "far_field", 0.75), ("sft", "clean", 0.5)], "stage string, scenario string, micro_cer double")
    got = {r.stage: tuple(r)[1:] for r in A.flat_summary(s, "stage", ["overall", "clean"], ["micro_cer"], ("far_field", "clean")).collect()}
    assert got == {"base": (0.5, 0.25, 0.5), "sft": (None, 0.5, None)}
    a = spark.createDataFrame([("x", 1, None), ("y", 2, 3), ("z", 4, 5)], "key string, n int, m int")
    b = spark.createDataFrame([("x", 1, None), ("y", 2, 4), ("w", 4, 5)], "key string, n int, m int")
    assert {tuple(r) for r in manifest.summary_diff(a, b, "key", ["n", "m"]).collect()} == {("y", "differs"), ("z", "not_computed"), ("w", "not_stored")}


def test_strip_status(spark):
    rows = spark.createDataFrame([("noise", "pair"), ("noise", "pair"), ("dropout", "pair"), ("dropout", "rejected")], "scenario string, bucket string")
    assert pairs.strip_status(rows, "new", ["old"], 1) == "passed" and pairs.strip_status(rows, "new", ["old"], 2) == "insufficient_data"
    with pytest.raises(ValueError, match="frozen"):
        pairs.strip_status(rows, "old", ["old"], 1)


def test_cross_split_works_its_rows_out_once_and_agrees_with_plain_python(spark):
    draw = random.Random(7)
    rows = [(f"u{n:03}", draw.choice([None, "a", "b", "c"]), draw.choice([None, "x", "y", "z", "w"]), draw.choice(["train", "val"])) for n in range(120)]
    df = spark.createDataFrame(rows, "source_id string, speaker_id string, text string, split string").withColumn("text", F.regexp_replace("text", "worked out", ""))
    out = windows.drop_cross_split(df, [("speaker_id", "speaker"), ("text", "text")])
    assert "worked out" not in out._jdf.queryExecution().optimizedPlan().toString()
    want, first = {}, {}
    for at, why in ((1, "speaker"), (2, "text")):
        for row in rows:
            if want.get(row[0]) is None:
                want[row[0]] = why if first.setdefault((at, row[at]), row[3]) != row[3] else None
    got = out.collect()
    assert out.columns == [*df.columns, "reason"] and len(got) == len(rows)
    assert {r.source_id: r.reason for r in got} == want and len(set(want.values())) == 3


def test_a_filter_on_a_text_problem_works_the_text_out_once(spark):
    df = spark.createDataFrame([("你好",), (None,), ("x",)], "t string").select(F.regexp_replace("t", "worked out", "").alias("t"))
    found = df.where(T.text_problem(F.col("t")).isNull())
    assert [r.t for r in found.collect()] == ["你好"]
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.toString().split("Filter ")[1].count("worked out") <= 1
