"""Manifest, selection and pair-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.hashing import candidate_seed, hash_split, keyed, scenario_seed
from quillstone.operators import aggregates as A
from quillstone.operators import joins, manifest, pairs, windows
from quillstone.plans import views as V

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


_UNIT = "('0x' || substr(sha256('42:u' || doc_id || ':split'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616"


@query(f"SELECT CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.1 + 0.15 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM (SELECT {_UNIT} AS u FROM documents) GROUP BY 1")
def hash_split_counts(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.groupBy(hash_split(42, F.concat(F.lit("u"), F.col("doc_id").cast("string")), 0.1, 0.15).alias("split")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, s AS scenario, ('0x' || substr(sha256('7:u' || doc_id || ':' || s), 1, 8))::BIGINT AS seed FROM documents, (VALUES ('noise'), ('dropout')) t(s)")
def scenario_seeds(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit("noise"), F.lit("dropout"))).alias("scenario"))
    return d.withColumn("seed", scenario_seed(7, F.concat(F.lit("u"), F.col("doc_id").cast("string")), F.col("scenario")))


@query("SELECT doc_id, (('0x' || substr(sha256('7:1:' || doc_id || ':d:0'), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS seed FROM documents")
def candidate_seeds(spark, sf_dir):
    one = lambda x: F.lit(x)
    return V.table(spark, sf_dir, "documents").select("doc_id", candidate_seed(7, one("1"), F.col("doc_id").cast("string"), one("d"), one("0")).alias("seed"))


#: A document's whole text, and beside it the same text with a fault or in Chinese characters.
_MADE = f"""CASE doc_id % 5 WHEN 0 THEN {V.HAN_SQL('text')} WHEN 1 THEN {V.HAN_SQL('text')} || '<|x' WHEN 2 THEN {V.DIGITS_SQL('text')} WHEN 3 THEN {V.BLANKED_SQL('text')} ELSE {V.HAN_SQL('text')} || ' a' END"""


@query(f"""SELECT doc_id, made, CASE WHEN {V.BLANK_SQL('t')} THEN 'empty_text' WHEN contains(t, 'language Chinese') OR contains(t, '<asr_text>') OR contains(t, '<|') THEN 'text_has_prompt_marker'
  WHEN regexp_matches(t, '[A-Za-z]') THEN 'text_has_latin' WHEN NOT regexp_matches(t, '[一-鿿]') THEN 'text_not_chinese' END AS reason
  FROM (SELECT doc_id, false AS made, text AS t FROM documents UNION ALL SELECT doc_id, true, {_MADE} FROM documents)""")
def text_problem_reasons(spark, sf_dir):
    k = F.col("doc_id") % 5
    t = F.when(k == 0, V.han("text")).when(k == 1, F.concat(V.han("text"), F.lit("<|x"))).when(k == 2, V.digits("text")).when(k == 3, V.blanked("text")).otherwise(F.concat(V.han("text"), F.lit(" a")))
    return V.beside(V.table(spark, sf_dir, "documents"), t).select("doc_id", "made", T.text_problem(F.col("text")).alias("reason"))


_CLASSIFIED = f"""WITH {V.SOURCES}, j AS (SELECT *, CASE WHEN extra THEN 'unknown_field' WHEN NOT regexp_matches(source_id, '^[A-Za-z0-9][A-Za-z0-9._:-]{{0,80}}$') THEN 'bad_source_id' END AS pre,
  CASE WHEN language <> 'zh' THEN 'language' WHEN {V.BLANK_SQL('text')} THEN 'empty_text' WHEN contains(text, 'language Chinese') OR contains(text, '<asr_text>') OR contains(text, '<|') THEN 'text_has_prompt_marker' WHEN regexp_matches(text, '[A-Za-z]') THEN 'text_has_latin'
    WHEN NOT regexp_matches(text, '[一-鿿]') THEN 'text_not_chinese' WHEN starts_with(audio, '../') THEN 'unsafe_audio_path' WHEN NOT has_audio THEN 'missing_audio' END AS post FROM sources),
c AS (SELECT *, CASE WHEN pre IS NOT NULL THEN pre WHEN line > min(line) FILTER (pre IS NULL AND post IS NULL) OVER (PARTITION BY source_id) THEN 'duplicate_source' ELSE post END AS reason FROM j)"""


def classified(spark, sf_dir):
    return manifest.classify_sources(V.sources(spark, sf_dir), F.col("has_audio"), F.col("extra"))


@query(_CLASSIFIED + " SELECT line, source_id, reason FROM c")
def source_classify_reasons(spark, sf_dir):
    return classified(spark, sf_dir).select("line", "source_id", "reason")


@query(_CLASSIFIED + " SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY reason")
def rejection_counts(spark, sf_dir):
    return A.reason_counts(classified(spark, sf_dir))


_KEPT = _CLASSIFIED + """, s AS (SELECT *, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.25 THEN 'val' ELSE 'train' END AS split FROM
  (SELECT *, ('0x' || substr(sha256('42:' || source_id || ':split'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 AS u FROM c WHERE reason IS NULL)),
a AS (SELECT *, split = first_value(split) OVER (PARTITION BY speaker_id ORDER BY source_id) AS ok1 FROM s),
b AS (SELECT *, split = first_value(split) OVER (PARTITION BY text ORDER BY source_id) AS ok2 FROM a WHERE ok1)"""


@query(_KEPT + " SELECT source_id, 'speaker_cross_split' AS why FROM a WHERE NOT ok1 UNION ALL SELECT source_id, CASE WHEN NOT ok2 THEN 'text_cross_split' END FROM b")
def first_wins_cross_split(spark, sf_dir):
    ok = manifest.assign_splits(classified(spark, sf_dir).where("reason is null").drop("reason"), 42, 0.1, 0.15)
    out = windows.drop_cross_split(ok, [("speaker_id", "speaker_cross_split"), ("text", "text_cross_split")])
    return out.select("source_id", F.col("reason").alias("why"))


@query(f"WITH {V.SOURCES} SELECT line, CASE WHEN row_number() OVER (PARTITION BY audio_sha ORDER BY line) > 1 THEN 'audio_hash_conflict' END AS reason FROM sources")
def keep_first_by_hash(spark, sf_dir):
    return windows.keep_first(V.sources(spark, sf_dir), "audio_sha", ["line"], "audio_hash_conflict").select("line", "reason")


@query(f"WITH {V.SOURCES} SELECT line, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY sha256('42:' || line || ':rank'), line::VARCHAR) > 1 THEN 'duplicate_text' END AS reason FROM sources")
def dedupe_text_by_rank(spark, sf_dir):
    rows = V.sources(spark, sf_dir).withColumn("utterance_id", F.col("line").cast("string"))
    return manifest.duplicate_texts(rows, 42, "rank").select("line", "reason")


_MANIFEST = f"""WITH {V.SAMPLES}, m AS (SELECT CASE WHEN line % 83 = 0 THEN 'zz' ELSE sample_id END AS sample_id, source_id, CASE WHEN line % 89 = 0 THEN '' ELSE reference END AS text,
  CASE WHEN line % 97 = 0 THEN 'odd' ELSE scenario END AS scenario, CASE WHEN line % 101 = 0 THEN 'test' ELSE split END AS split, 'w.wav' AS audio FROM samples)"""


def _manifest(spark, sf_dir):
    k = F.col("line")
    return V.samples(spark, sf_dir).select(
        F.when(k % 83 == 0, "zz").otherwise(F.col("sample_id")).alias("sample_id"), "source_id", F.when(k % 89 == 0, "").otherwise(F.col("reference")).alias("text"),
        F.when(k % 97 == 0, "odd").otherwise(F.col("scenario")).alias("scenario"), F.when(k % 101 == 0, "test").otherwise(F.col("split")).alias("split"), F.lit("w.wav").alias("audio"),
    )


_PROBLEMS = _MANIFEST + """, p AS (SELECT 'missing_text' AS code, sample_id AS key FROM m WHERE trim(text) = '' UNION ALL SELECT 'bad_scenario', sample_id FROM m WHERE scenario = 'odd'
  UNION ALL SELECT 'sample_id_mismatch', sample_id FROM m WHERE sample_id <> source_id || '__' || scenario UNION ALL SELECT 'duplicate_sample', sample_id FROM m GROUP BY sample_id HAVING count(*) > 1
  UNION ALL SELECT 'source_scenarios', source_id FROM m GROUP BY source_id HAVING count(DISTINCT scenario) < 5 UNION ALL SELECT 'source_text', source_id FROM m GROUP BY source_id HAVING count(DISTINCT text) > 1
  UNION ALL SELECT 'leak_source', source_id FROM m GROUP BY source_id HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'leak_text', text FROM m GROUP BY text HAVING count(DISTINCT split) > 1)"""


@query(_PROBLEMS + " SELECT code, key FROM p")
def manifest_problems(spark, sf_dir):
    return manifest.manifest_problems(_manifest(spark, sf_dir))


@query(_PROBLEMS + " SELECT CASE WHEN (SELECT count(*) FROM p) > 0 THEN 'failed' ELSE 'passed' END AS status, CASE WHEN (SELECT count(*) FROM p) > 0 THEN 1 ELSE 0 END AS exit_code")
def manifest_status(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    return manifest.manifest_status(manifest.manifest_problems(m), manifest.shortages(m, 100))


@query(_MANIFEST + """ SELECT s.split, c.scenario, count(m.sample_id) AS rows, count(DISTINCT m.source_id) AS sources FROM (VALUES ('train'), ('val'), ('test')) s(split)
  CROSS JOIN (VALUES ('clean'), ('noise'), ('reverb'), ('far_field'), ('dropout')) c(scenario) LEFT JOIN m USING (split, scenario) GROUP BY 1, 2""")
def split_scenario_counts_zero_filled(spark, sf_dir):
    return manifest.counts_by_split(_manifest(spark, sf_dir))


@query(_MANIFEST + " SELECT source_id, list_sort(list(DISTINCT split)) AS splits FROM m GROUP BY source_id HAVING count(DISTINCT split) > 1")
def leakage_intersections(spark, sf_dir):
    return A.split_intersections(_manifest(spark, sf_dir), "source_id")


@query(f"WITH {V.SOURCES} SELECT language, min(duration_ms) AS minimum, median(duration_ms)::DOUBLE AS median, max(duration_ms) AS maximum FROM sources GROUP BY language")
def duration_median(spark, sf_dir):
    return A.duration_range(V.sources(spark, sf_dir), "duration_ms", ["language"])


@query(f"""WITH {V.SOURCES}, v AS (SELECT list_sort(list(duration_ms / 1000.0::DOUBLE)) AS v, count(*) AS n FROM sources WHERE duration_ms IS NOT NULL)
SELECT round(v[round_even(0.1 * (n - 1), 0)::INT + 1], 4) AS q10, round(v[round_even(0.5 * (n - 1), 0)::INT + 1], 4) AS q50, round(v[round_even(0.95 * (n - 1), 0)::INT + 1], 4) AS q95 FROM v""")
def nearest_rank_quantiles(spark, sf_dir):
    return A.nearest_rank(V.sources(spark, sf_dir).withColumn("sec", F.col("duration_ms") / 1000.0), "sec", [0.1, 0.5, 0.95])


_PILOT = f"""WITH {V.SOURCES}, t AS (SELECT 'k' || line AS utterance_id, text FROM sources WHERE line % 7 <> 0),
d AS (SELECT 'k' || line AS utterance_id, CASE WHEN line % 17 = 0 THEN 'eval' ELSE 'train' END AS official_split, line % 19 <> 0 AS format_ok, CASE WHEN line % 23 = 0 THEN 4 ELSE 0 END AS clipped_samples, duration_ms FROM sources WHERE line % 5 <> 0),
x AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE utterance_id LIKE '%13'), dup AS (SELECT utterance_id FROM x GROUP BY 1 HAVING count(*) > 1), o AS (SELECT * FROM x WHERE utterance_id NOT IN (SELECT utterance_id FROM dup))"""


def _pilot(spark, sf_dir):
    s = V.sources(spark, sf_dir).withColumn("utterance_id", F.concat(F.lit("k"), F.col("line").cast("string")))
    t = s.where("line % 7 <> 0").select("utterance_id", "text")
    d = s.where("line % 5 <> 0").select(
        "utterance_id", F.when(F.col("line") % 17 == 0, "eval").otherwise("train").alias("official_split"), (F.col("line") % 19 != 0).alias("format_ok"),
        F.when(F.col("line") % 23 == 0, 4).otherwise(0).alias("clipped_samples"), "duration_ms",
    )
    return t, d.unionByName(d.where(F.col("utterance_id").endswith("13")))


@query(_PILOT + """ SELECT coalesce(t.utterance_id, o.utterance_id) AS utterance_id, CASE WHEN o.utterance_id IS NULL THEN 'missing_duration' ELSE 'missing_transcript' END AS reason
  FROM t FULL JOIN o ON t.utterance_id = o.utterance_id WHERE t.utterance_id IS NULL OR o.utterance_id IS NULL UNION ALL SELECT utterance_id, 'duplicate_duration' FROM dup""")
def full_outer_missing_reasons(spark, sf_dir):
    return joins.missing_either(*_pilot(spark, sf_dir), "utterance_id", "missing_duration", "missing_transcript", "duplicate_duration")


@query(_PILOT + f""" SELECT coalesce(t.utterance_id, o.utterance_id) AS utterance_id, CASE WHEN o.utterance_id IS NULL THEN 'missing_duration' WHEN t.utterance_id IS NULL THEN 'missing_transcript'
  WHEN official_split = 'eval' THEN 'bad_official_split' WHEN {V.BLANK_SQL('text')} THEN 'empty_text' WHEN contains(text, 'language Chinese') OR contains(text, '<asr_text>') OR contains(text, '<|') THEN 'text_has_prompt_marker' WHEN regexp_matches(text, '[A-Za-z]') THEN 'text_has_latin'
  WHEN NOT regexp_matches(text, '[一-鿿]') THEN 'text_not_chinese' WHEN NOT format_ok THEN 'bad_format' WHEN clipped_samples > 0 THEN 'hard_clip' WHEN duration_ms BETWEEN 500 AND 30000 THEN NULL ELSE 'duration_out_of_range' END AS reason
  FROM t FULL JOIN o ON t.utterance_id = o.utterance_id UNION ALL SELECT utterance_id, 'duplicate_duration' FROM dup""")
def pilot_eligibility(spark, sf_dir):
    return manifest.pilot_eligibility(*_pilot(spark, sf_dir))


_TURNS = f"WITH {V.SOURCES}, k AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY sha256('42:' || line || ':pilot'), line) AS turn FROM sources WHERE duration_ms IS NOT NULL), p AS (SELECT *, row_number() OVER (ORDER BY turn, speaker_id) AS position, coalesce(sum(duration_ms) OVER (ORDER BY turn, speaker_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)"


def _ranked(spark, sf_dir):
    return V.sources(spark, sf_dir).where("duration_ms is not null").select("line", "speaker_id", "duration_ms", keyed(42, F.col("line").cast("string"), "pilot").alias("rank"))


@query(_TURNS + " SELECT line, turn, position FROM p WHERE position <= 150")
def round_robin_count(spark, sf_dir):
    return windows.round_robin(_ranked(spark, sf_dir), "speaker_id", "duration_ms", ["rank", "line"], count=150).select("line", "turn", "position")


@query(_TURNS + " SELECT line, turn, position FROM p WHERE before < 1500000")
def round_robin_target(spark, sf_dir):
    return windows.round_robin(_ranked(spark, sf_dir), "speaker_id", "duration_ms", ["rank", "line"], target=1_500_000).select("line", "turn", "position")


@query(f"""WITH RECURSIVE {V.SOURCES}, k AS (SELECT speaker_id, line, duration_ms, row_number() OVER (PARTITION BY speaker_id ORDER BY sha256('42:' || line || ':pilot'), line) AS i FROM sources WHERE duration_ms IS NOT NULL),
c AS (SELECT DISTINCT speaker_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS turn, NULL::BIGINT AS line, NULL::BIGINT AS duration_ms, false AS taken FROM k
  UNION ALL SELECT k.speaker_id, k.i, c.used + CASE WHEN c.used + k.duration_ms <= 30000 THEN k.duration_ms ELSE 0 END, c.turn + CASE WHEN c.used + k.duration_ms <= 30000 THEN 1 ELSE 0 END, k.line, k.duration_ms, c.used + k.duration_ms <= 30000
  FROM c JOIN k ON k.speaker_id = c.speaker_id AND k.i = c.i + 1),
p AS (SELECT line, turn, row_number() OVER w AS position, duration_ms, coalesce(sum(duration_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE taken WINDOW w AS (ORDER BY turn, speaker_id))
SELECT line, turn, position FROM p WHERE before < 900000 AND (SELECT sum(duration_ms) FROM p) >= 900000""")
def round_robin_capped(spark, sf_dir):
    return windows.round_robin(_ranked(spark, sf_dir), "speaker_id", "duration_ms", ["rank", "line"], target=900_000, cap=30_000).select("line", "turn", "position")


_PAIRS = f"""WITH {V.SCORED}, q AS (SELECT *, levenshtein(r, p)::BIGINT AS edits, length(reference) + 1 AS ct, length(prediction) + 1 AS rt FROM scored),
pr AS (SELECT *, CASE WHEN failed THEN 'inference_error' WHEN p = '' THEN 'empty_rejected' WHEN edits = 0 THEN 'tie' WHEN ct > 401 OR rt > 401 THEN 'overlength' END AS reason FROM q)"""


def paired(spark, sf_dir):
    return pairs.classify_pairs(V.samples(spark, sf_dir), 400)


@query(_PAIRS + " SELECT sample_id, CASE WHEN reason IS NULL THEN 'pair' WHEN reason = 'overlength' THEN reason ELSE 'rejected' END AS bucket, reason, edits AS edit_count, (length(p) - length(r))::BIGINT AS char_length_delta FROM pr")
def pair_buckets(spark, sf_dir):
    return paired(spark, sf_dir).select("sample_id", "bucket", "reason", "edit_count", "char_length_delta")


@query(_PAIRS + """ SELECT d.s AS scenario, (SELECT count(*) FROM pr WHERE scenario = d.s) AS manifest_rows, count(pr.sample_id) AS pairs, count(DISTINCT source_id) AS sources,
  round(count(pr.sample_id)::DOUBLE / nullif((SELECT count(*) FROM pr WHERE scenario = d.s), 0), 9) AS retention, round(avg(length(p) - length(r)), 9) AS mean_char_delta, round(avg(rt - ct), 9) AS mean_token_delta
  FROM (VALUES ('clean'), ('dropout'), ('noise'), ('absent')) d(s) LEFT JOIN pr ON pr.scenario = d.s AND reason IS NULL GROUP BY d.s""")
def pair_summary(spark, sf_dir):
    p = paired(spark, sf_dir)
    out = A.pair_summary(p, p.where("bucket = 'pair'"), A.dimension(spark, scenario=("clean", "dropout", "noise", "absent")))
    return out.withColumns({c: F.round(c, 9) for c in ("retention", "mean_char_delta", "mean_token_delta")})


@query(_PAIRS + """, c AS (SELECT source_id, p AS cp FROM pr WHERE reason IS NULL AND scenario = 'clean') SELECT sample_id FROM pr LEFT JOIN c USING (source_id)
  WHERE reason IS NULL AND scenario <> 'clean' AND (cp IS NULL OR p <> cp) AND edits <= 60""")
def pair_filter(spark, sf_dir):
    return pairs.filter_pairs(paired(spark, sf_dir).where("bucket = 'pair'"), exclude_clean=True, most_edits=60).select("sample_id")


@query()
def gap_strip(spark, sf_dir):
    p = paired(spark, sf_dir).where("bucket = 'pair'").drop("bucket", "reason")
    return pairs.strip_gaps(p, 400).select("sample_id", "chosen_text", "rejected_text", "edit_count", "char_length_delta", "bucket", "reason")


@query(_PAIRS + """ SELECT scenario, sample_id, position FROM (SELECT *, row_number() OVER (PARTITION BY split, scenario ORDER BY sha256(concat_ws(chr(10), '42', split, scenario, sample_id)), sample_id) AS position
  FROM pr WHERE reason IS NULL) WHERE position <= 20""")
def audit_topk_per_group(spark, sf_dir):
    p = paired(spark, sf_dir).where("bucket = 'pair'")
    rank = keyed(42, F.col("split"), F.col("scenario"), F.col("sample_id"), sep="\n")
    return windows.top_k_per_group(p, ["split", "scenario"], rank, 20, "sample_id").select("scenario", "sample_id", "position")


@query(_PAIRS + " SELECT sample_id FROM pr WHERE reason IS NULL ORDER BY sha256(concat_ws(chr(10), '42', split, sample_id)), sample_id LIMIT 12")
def recheck_topk(spark, sf_dir):
    return windows.top_k(paired(spark, sf_dir).where("bucket = 'pair'"), keyed(42, F.col("split"), F.col("sample_id"), sep="\n"), 12, "sample_id").select("sample_id")


@query(f"WITH {V.SAMPLES} SELECT sample_id, row_number() OVER (ORDER BY sha256('42:1:' || sample_id || ':sft-sampler-v1'), sample_id) AS position FROM samples WHERE split = 'train'")
def epoch_order(spark, sf_dir):
    s = V.samples(spark, sf_dir).where("split = 'train'").select("sample_id", keyed(42, 1, F.col("sample_id"), "sft-sampler-v1").alias("rank"))
    return windows.global_index(s, ["rank", "sample_id"], "position").select("sample_id", "position")


@query(f"""WITH {V.SAMPLES}, o AS (SELECT sample_id, split, (row_number() OVER (PARTITION BY split ORDER BY line) - 1) // 8 AS window_id FROM samples) SELECT split, window_id, count(*) AS n FROM o GROUP BY ALL""")
def accumulation_windows(spark, sf_dir):
    w = windows.count_windows(V.samples(spark, sf_dir), ["line"], 8, epoch="split")
    return w.groupBy("split", "window_id").agg(F.count("*").alias("n"))


@query(f"WITH {V.SAMPLES}, a AS (SELECT sample_id, row_number() OVER (ORDER BY line) AS n, count(*) OVER () AS c FROM samples WHERE scenario = 'dropout'), o AS (SELECT r AS \"offset\", (6 * 7 + r) AS i FROM range(7) t(r)) SELECT \"offset\"::INT AS \"offset\", sample_id FROM o JOIN a ON a.n = o.i % a.c + 1")
def anchor_cycle(spark, sf_dir):
    s = V.samples(spark, sf_dir).where("scenario = 'dropout'").select("sample_id", "line")
    return windows.anchor_slice(s, "line", 7, 7).select("offset", "sample_id")


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def sha_index(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
