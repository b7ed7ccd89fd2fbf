"""Scoring, benchmark and gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import sequence as S
from quillstone.functions import text as T
from quillstone.operators import aggregates as A
from quillstone.operators import gates, joins, windows
from quillstone.plans import views as V

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


def scored(spark: SparkSession, sf_dir: str, word: bool = False) -> DataFrame:
    """Manifest and predictions joined one to one, and scored."""
    s = V.samples(spark, sf_dir)
    manifest = s.select("sample_id", "source_id", "scenario", "split", "line", "reference")
    predictions = s.select("sample_id", "prediction", "error", "stop_reason")
    rows = joins.strict_one_to_one(manifest, predictions, "sample_id")
    out = rows.withColumns(S.scored(F.col("reference"), F.col("prediction"), F.col("error"), F.col("stop_reason")))
    if word:
        words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
        out = out.withColumns(S.word_scored(words(F.col("reference")), words(F.col("prediction")), F.col("inference_error")))
    return out


_RATES = """avg(empty_output::INT)::DOUBLE AS empty_rate, avg(repeated_output::INT)::DOUBLE AS repeated_rate, avg(long_output::INT)::DOUBLE AS long_rate,
  avg(truncated::INT)::DOUBLE AS truncation_rate, avg(inference_error::INT)::DOUBLE AS inference_error_rate, avg(valid_output::INT)::DOUBLE AS valid_output_rate"""
_ROUNDED = """round(avg(empty_output::INT), 9) AS empty_rate, round(avg(repeated_output::INT), 9) AS repeated_rate, round(avg(long_output::INT), 9) AS long_rate,
  round(avg(truncated::INT), 9) AS truncation_rate, round(avg(inference_error::INT), 9) AS inference_error_rate, round(avg(valid_output::INT), 9) AS valid_output_rate"""
_SUMMARY = f"""count(*) AS samples, sum(edit_count)::BIGINT AS edit_count, sum(reference_char_count)::BIGINT AS reference_char_count,
  round(sum(edit_count)::DOUBLE / sum(reference_char_count), 9) AS micro_cer, round(avg(sample_cer), 9) AS macro_cer, {_ROUNDED}"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


@query(f"WITH {V.SCORED} SELECT scenario, {_SUMMARY} FROM scored GROUP BY scenario")
def cer_by_scenario(spark, sf_dir):
    return rounded(A.scenario_summary(scored(spark, sf_dir)))


@query(f"WITH {V.SCORED} SELECT coalesce(scenario, 'overall') AS scenario, {_SUMMARY} FROM scored GROUP BY GROUPING SETS ((), (scenario))")
def cer_overall_rollup(spark, sf_dir):
    return rounded(A.overall_and_scenarios(scored(spark, sf_dir)))


@query(f"""WITH {V.SCORED} SELECT sample_id, r AS reference_normalized, p AS prediction_normalized, judged AS scored_prediction_normalized, edit_count, reference_char_count,
  round(sample_cer, 9) AS sample_cer, empty_output, repeated_output, long_output, truncated, inference_error, valid_output FROM scored""")
def score_rows(spark, sf_dir):
    names = ["reference_normalized", "prediction_normalized", "scored_prediction_normalized", "edit_count", "reference_char_count", "sample_cer", "empty_output", "repeated_output", "long_output", "truncated", "inference_error", "valid_output"]
    return rounded(scored(spark, sf_dir).select("sample_id", *names))


@query("""SELECT doc_id, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\p{P}\\p{Z}\\p{Cc}]', '', 'g')) AS normal_sha FROM documents""")
def normalize_text(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize("text"), 256).alias("normal_sha"))


@query("""SELECT doc_id, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\p{P}\\p{Z}\\p{Cc}]', '', 'g')) AS normal_sha FROM documents""")
def normalize_text_fast(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_fast(F.col("text")), 256).alias("normal_sha"))


@query()
def token_wer(spark, sf_dir):
    return rounded(A.scenario_summary(scored(spark, sf_dir, word=True), wer=True))


@query()
def align_ops(spark, sf_dir):
    """Alignment operations over all samples, by scenario and operation."""
    rows = scored(spark, sf_dir).select("scenario", F.explode(S.align_chars("reference_normalized", "scored_prediction_normalized")).alias("o"))
    return rows.groupBy("scenario", "o.op").agg(F.count("*").alias("n"))


@query(f"""WITH {V.SCORED} SELECT source_id, problem FROM (SELECT source_id, CASE WHEN count(DISTINCT scenario) < 5 OR count(*) <> 5 THEN 'scenarios' WHEN count(DISTINCT reference) <> 1 THEN 'text' END AS problem FROM
  (SELECT * FROM samples WHERE line % 37 <> 0) GROUP BY source_id) WHERE problem IS NOT NULL""")
def incomplete_sources(spark, sf_dir):
    return joins.incomplete_sources(V.samples(spark, sf_dir).where("line % 37 <> 0"), "source_id", "scenario", V.SCENARIOS, "reference")


_BROKEN = """l AS (SELECT CASE WHEN line % 41 = 0 THEN NULL ELSE sample_id END AS sample_id, reference FROM samples WHERE line % 17 <> 0),
r AS (SELECT sample_id, CASE WHEN line % 19 = 0 THEN 'other' ELSE reference END AS reference FROM samples WHERE line % 13 <> 0 UNION ALL SELECT sample_id, reference FROM samples WHERE line % 29 = 0)"""


@query(f"""WITH {V.SAMPLES}, {_BROKEN}, a AS (SELECT sample_id, count(*) AS n, min(reference) AS t FROM l GROUP BY 1),
b AS (SELECT sample_id, count(*) AS n, min(reference) AS t FROM r GROUP BY 1),
j AS (SELECT coalesce(a.sample_id, b.sample_id) AS k, a.n AS an, b.n AS bn, a.t AS atext, b.t AS btext FROM a FULL JOIN b ON a.sample_id IS NOT DISTINCT FROM b.sample_id),
c AS (SELECT CASE WHEN k IS NULL AND an > 0 THEN 'blank_left' WHEN an > 1 THEN 'duplicate_left' END AS code FROM j UNION ALL
  SELECT CASE WHEN k IS NULL AND bn > 0 THEN 'blank_right' WHEN bn > 1 THEN 'duplicate_right' END FROM j UNION ALL
  SELECT CASE WHEN k IS NULL THEN NULL WHEN bn IS NULL THEN 'missing_right' WHEN an IS NULL THEN 'extra_right' END FROM j UNION ALL
  SELECT CASE WHEN bn = 1 AND an IS NOT NULL AND atext <> btext THEN 'mismatch_reference' END FROM j)
SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY code""")
def strict_join_contract_violations(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    left = s.where("line % 17 <> 0").select(F.when(F.col("line") % 41 != 0, F.col("sample_id")).alias("sample_id"), "reference")
    some = s.where("line % 13 <> 0").select("sample_id", F.when(F.col("line") % 19 == 0, "other").otherwise(F.col("reference")).alias("reference"))
    again = s.where("line % 29 = 0").select("sample_id", "reference")
    once = some.unionByName(again).groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select("sample_id")
    codes = joins.join_violations(left, some.unionByName(again), "sample_id", ["reference"])
    # of a duplicated row, either text may be compared
    codes = codes.join(once.withColumn("twice", F.lit(True)), "sample_id", "left").where("not (code = 'mismatch_reference' and coalesce(twice, false))")
    return codes.groupBy("code").agg(F.count("*").alias("n"))


_STAGES = """stages AS (SELECT stage, stage_no, scenario, count(*) AS samples, sum(greatest(0, edit_count - stage_no * (line % 3)))::DOUBLE / sum(reference_char_count) AS micro_cer
  FROM scored, (VALUES ('base', 0), ('sft', 1), ('dpo', 2), ('rl', 3)) t(stage, stage_no) GROUP BY ALL)"""


def staged(spark, sf_dir) -> DataFrame:
    """A metrics row for each of four stages and scenario; later stages make fewer edits."""
    names = spark.createDataFrame([("base", 0), ("sft", 1), ("dpo", 2), ("rl", 3)], "stage string, stage_no int")
    rows = scored(spark, sf_dir).select("scenario", "line", "edit_count", "reference_char_count").join(F.broadcast(names), F.lit(True))
    fewer = F.greatest(F.lit(0), F.col("edit_count") - F.col("stage_no") * (F.col("line") % 3))
    return rows.groupBy("stage", "stage_no", "scenario").agg(F.count("*").alias("samples"), A.ratio(F.sum(fewer), F.sum("reference_char_count")).alias("micro_cer"), F.sum(fewer).alias("edit_count"))


@query(f"""WITH {V.SCORED}, {_STAGES} SELECT stage, scenario, round(micro_cer, 9) AS micro_cer, round(micro_cer - first_value(micro_cer) OVER w, 9) AS delta_base,
  round(micro_cer - coalesce(lag(micro_cer) OVER w, micro_cer), 9) AS delta_previous FROM stages WINDOW w AS (PARTITION BY scenario ORDER BY stage_no)""")
def stage_deltas(spark, sf_dir):
    d = windows.stage_deltas(staged(spark, sf_dir), "stage", F.col("stage_no"), "micro_cer", ["scenario"])
    return rounded(d.select("stage", "scenario", "micro_cer", "delta_base", "delta_previous"))


@query(f"""WITH {V.SCORED}, {_STAGES} SELECT stage, round(sum(micro_cer) / 4, 9) AS degraded_macro_cer FROM stages WHERE scenario <> 'clean' GROUP BY stage""")
def degraded_macro(spark, sf_dir):
    s = staged(spark, sf_dir)
    parts = [A.degraded_macro(s.where(F.col("stage") == n)).select(F.lit(n).alias("stage"), F.round("degraded_macro_cer", 9).alias("degraded_macro_cer")) for n in ("base", "sft", "dpo", "rl")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {V.SCORED}, {_STAGES}, d AS (SELECT stage_no AS step, sum(micro_cer) FILTER (scenario <> 'clean') / 4 AS degraded_macro_cer, max(micro_cer) FILTER (scenario = 'clean') AS clean_cer
  FROM stages GROUP BY stage_no) SELECT step, round(degraded_macro_cer, 9) AS degraded_macro_cer, round(clean_cer, 9) AS clean_cer FROM d WHERE step <> 3 ORDER BY d.degraded_macro_cer, d.clean_cer, step LIMIT 1""")
def best_checkpoint(spark, sf_dir):
    d = staged(spark, sf_dir).groupBy(F.col("stage_no").alias("step")).agg(
        A.ratio(F.sum(F.when(F.col("scenario") != "clean", F.col("micro_cer"))), F.lit(4)).alias("degraded_macro_cer"), F.max(F.when(F.col("scenario") == "clean", F.col("micro_cer"))).alias("clean_cer")
    )
    return rounded(windows.best_checkpoint(d.withColumn("passed", F.col("step") != 3)).drop("passed"))


GATE = {
    "min_rows_per_scenario": 50, "empty_rate_max": 0.05, "repeated_rate_max": 0.05, "long_rate_max": 0.05, "truncation_rate_max": 0.2, "valid_output_rate_min": 0.9,
    "clean_cer_increase_max": 0.01, "clean_cer_increase_vs_base_max": 0.02, "scenario_cer_increase_max": 0.02, "degraded_macro_increase_max": 0.0,
    "min_preference_accuracy": 0.55, "min_val_pairs": 100, "raw_kl_max": 0.05, "reward_drop_stop": 0.02, "min_reward_improvement": 0.001,
}


def _baseline(metrics: DataFrame) -> DataFrame:
    """The same metrics, a little lower in every other scenario."""
    return metrics.withColumn("micro_cer", F.col("micro_cer") - F.when(F.col("scenario").isin("clean", "noise", "overall"), 0.03).otherwise(-0.001))


_GATE_SQL = f"""WITH {V.SCORED}, m AS (SELECT coalesce(scenario, 'overall') AS scenario, count(*) AS samples, sum(edit_count)::DOUBLE / sum(reference_char_count) AS micro_cer, {_RATES}
  FROM scored GROUP BY GROUPING SETS ((), (scenario))),
d AS (SELECT scenario, CASE WHEN scenario IN ('clean', 'noise', 'overall') THEN 0.03 ELSE -0.001 END::DOUBLE AS delta FROM m),
v AS (SELECT 'rows' AS code, scenario AS scope, samples::DOUBLE AS value FROM m WHERE scenario <> 'overall' AND samples < 50
UNION ALL SELECT 'empty_rate', scenario, empty_rate FROM m WHERE empty_rate > 0.05 UNION ALL SELECT 'repeated_rate', scenario, repeated_rate FROM m WHERE repeated_rate > 0.05
UNION ALL SELECT 'long_rate', scenario, long_rate FROM m WHERE long_rate > 0.05 UNION ALL SELECT 'truncation_rate', scenario, truncation_rate FROM m WHERE truncation_rate > 0.2
UNION ALL SELECT 'valid_output_rate', scenario, valid_output_rate FROM m WHERE valid_output_rate < 0.9
UNION ALL SELECT 'clean_increase', scenario, delta FROM d WHERE scenario = 'clean' UNION ALL SELECT 'clean_increase_vs_base', scenario, delta FROM d WHERE scenario = 'clean'
UNION ALL SELECT 'scenario_increase', scenario, delta FROM d WHERE scenario = 'noise' UNION ALL SELECT 'macro_increase', 'degraded', (0.03 - 3 * 0.001) / 4)
SELECT code, scope, round(value, 9) AS value FROM v"""


@query(_GATE_SQL)
def gate_violations(spark, sf_dir):
    m = A.overall_and_scenarios(scored(spark, sf_dir))
    return rounded(gates.sft_violations(m, _baseline(m), GATE))


@query(f"WITH q AS ({_GATE_SQL}) SELECT count(*) = 0 AND false AS passed, count(*) > 0 AS risk_stop, count(*) AS n_risks, 3::BIGINT AS improved FROM q")
def gate_decision(spark, sf_dir):
    m = A.overall_and_scenarios(scored(spark, sf_dir))
    base = _baseline(m)
    d = gates.decision(gates.sft_violations(m, base, GATE), gates.improved(m, base), 2)
    return d.select("passed", "risk_stop", F.size("risks").cast("long").alias("n_risks"), "improved")


@query(f"""WITH {V.SCORED}, g AS (SELECT DISTINCT split FROM samples) SELECT g.split, x.s AS scenario, count(scored.sample_id) AS samples, coalesce(sum(edit_count), 0)::BIGINT AS edit_count,
  coalesce(sum(reference_char_count), 0)::BIGINT AS reference_char_count, round(coalesce(sum(edit_count)::DOUBLE / sum(reference_char_count), 0), 9) AS micro_cer
  FROM g CROSS JOIN (VALUES ('near_field'), ('noise'), ('reverb')) x(s) LEFT JOIN scored ON scored.split = g.split AND scored.scenario = x.s GROUP BY 1, 2""")
def meeting_breakdown(spark, sf_dir):
    wanted = ["near_field", "noise", "reverb"]
    return rounded(A.breakdown(scored(spark, sf_dir).where(F.col("scenario").isin(*wanted)).unionByName(scored(spark, sf_dir).where("scenario = 'absent'")), "split", wanted))


@query(f"""WITH {V.SAMPLES}, e AS (SELECT sample_id, prediction, stop_reason FROM samples WHERE line % 23 <> 0), a AS (SELECT sample_id, CASE WHEN line % 9 = 0 THEN 'x' ELSE prediction END AS prediction,
  CASE WHEN line % 6 = 0 THEN NULL ELSE stop_reason END AS stop_reason FROM samples WHERE line % 21 <> 0)
SELECT sample_id, problem FROM (SELECT coalesce(e.sample_id, a.sample_id) AS sample_id, CASE WHEN a.sample_id IS NULL THEN 'missing' WHEN e.sample_id IS NULL THEN 'extra' ELSE
  nullif(concat_ws(',', CASE WHEN e.prediction IS DISTINCT FROM a.prediction THEN 'prediction' END, CASE WHEN e.stop_reason IS DISTINCT FROM a.stop_reason THEN 'stop_reason' END), '') END AS problem
  FROM e FULL JOIN a ON e.sample_id = a.sample_id) WHERE problem IS NOT NULL""")
def readback_diff(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    a = s.where("line % 21 <> 0").select("sample_id", F.when(F.col("line") % 9 == 0, "x").otherwise(F.col("prediction")).alias("prediction"), F.when(F.col("line") % 6 != 0, F.col("stop_reason")).alias("stop_reason"))
    return joins.readback_diff(s.where("line % 23 <> 0"), a, "sample_id", ["prediction", "stop_reason"])


@query("""SELECT 'r' || r.r_regionkey AS release, CASE WHEN p.r_regionkey IS NULL THEN 'unknown_parent' ELSE 'parent_sha_mismatch' END AS problem
FROM region r LEFT JOIN region p ON p.r_regionkey = r.r_regionkey * 2 - 1 WHERE r.r_regionkey > 0 AND (p.r_regionkey IS NULL OR r.r_regionkey % 2 = 1)""")
def lineage_check(spark, sf_dir):
    k = F.col("r_regionkey")
    sha = lambda c: F.sha2(c.cast("string"), 256)
    rel = V.table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), k).alias("release"), F.when(k > 0, F.concat(F.lit("r"), k * 2 - 1)).alias("parent"),
        F.when(k % 2 == 1, sha(k * 100)).otherwise(sha(k * 2 - 1)).alias("parent_sha"), sha(k).alias("adapter_sha"),
    )
    return joins.lineage_breaks(rel)


@query(f"""WITH {V.SCORED}, s AS (SELECT source_id, sum(edit_count) AS a, sum(greatest(0, edit_count - line % 3)) AS b, sum(reference_char_count) AS refs, row_number() OVER (ORDER BY source_id) - 1 AS i FROM scored GROUP BY source_id),
n AS (SELECT count(*) AS n FROM s), p AS (SELECT draw, ('0x' || substr(sha256('42:' || draw || ':' || pick), 1, 8))::BIGINT % n AS i FROM n, range(2000) t(draw), range(n.n) u(pick))
SELECT draw, round(sum(b - a)::DOUBLE / sum(refs), 9) AS delta FROM p JOIN s USING (i) GROUP BY draw""")
def bootstrap_hash_variant(spark, sf_dir):
    rows = scored(spark, sf_dir).select("source_id", F.col("edit_count").alias("a"), F.greatest(F.lit(0), F.col("edit_count") - F.col("line") % 3).alias("b"), F.col("reference_char_count").alias("refs"))
    return rounded(A.bootstrap_hashed(A.cluster_sums(rows, "source_id", ["a", "b"], "refs"), "source_id", "a", "b", "refs", draws=2000))


@query()
def bootstrap_numpy(spark, sf_dir):
    rows = scored(spark, sf_dir).select("source_id", F.col("edit_count").alias("a"), F.greatest(F.lit(0), F.col("edit_count") - F.col("line") % 3).alias("b"), F.col("reference_char_count").alias("refs"))
    sums = A.cluster_sums(rows, "source_id", ["a", "b"], "refs").withColumn("comparison", F.lit("later - base"))
    return A.bootstrap_numpy(sums, "comparison", "source_id", "a", "b", "refs")
