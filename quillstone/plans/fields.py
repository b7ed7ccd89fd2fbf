"""Queries over single fields and small contracts: text rules, token arrays, schedules, training rows.

Each takes all rows of its tables; the fields that the tables lack follow from a row's numbers
and texts by fixed rules, stated once for Spark and once for SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import hashing, maths
from quillstone.functions import sequence as S
from quillstone.functions import text as T
from quillstone.operators import aggregates as A
from quillstone.operators import gates, joins, manifest, pairs, timeline, windows
from quillstone.plans import views as V
from quillstone.plans.curation import _MANIFEST, _PROBLEMS, _manifest
from quillstone.streaming import logs

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


def _docs(spark, sf_dir):
    return V.table(spark, sf_dir, "documents")


def _case(k, *values):
    """values[k]; the last for every other k."""
    out = F
    for n, v in enumerate(values[:-1]):
        out = out.when(k == n, v)
    return out.otherwise(values[-1])


def _text(c):
    return F.col(c).cast("string")


# --- text rules -----------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(regexp_matches(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'a', 'ａ') ELSE replace(text, 'E', 'Ｅ') END, '[Ａ-Ｚａ-ｚ]'), false) AS wide FROM documents")
def fullwidth_latin(spark, sf_dir):
    t = _case(F.col("doc_id") % 3, F.col("text"), F.replace("text", F.lit("a"), F.lit("ａ")), F.replace("text", F.lit("E"), F.lit("Ｅ")))
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(t.rlike(T.FULLWIDTH_LATIN), F.lit(False)).alias("wide"))


def _both_sql(made):
    """Rows (doc_id, made, t): each document's text, and beside it what `made` makes of it."""
    return f"(SELECT doc_id, false AS made, text AS t FROM documents UNION ALL SELECT doc_id, true, {made} FROM documents)"


_ENDS = f"'^[{V.SPACE_SQL}]+|[{V.SPACE_SQL}]+$'"
_NOT_SILENT = "(?i)^(?:\\s|<sil>|\\(sil\\)|sil|<space>|<_>)*$"
_WORDS = "regexp_replace(text, '\\S+', '{}', 'g')"
_MARK = f"""CASE doc_id % 7 WHEN 0 THEN '<SIL> sil' || {V.BLANKED_SQL('text')} WHEN 1 THEN {V.BLANKED_SQL('text')} WHEN 2 THEN {_WORDS.format('<_><space>')} WHEN 3 THEN {_WORDS.format('(sil)')} WHEN 4 THEN {_WORDS.format('sil')} || text
  WHEN 5 THEN NULL ELSE '  <sil>  ' || {_WORDS.format('Sil')} || ' <sil' END"""


@query(f"SELECT doc_id, made, NOT regexp_matches(m, '{_NOT_SILENT}') AS active FROM (SELECT doc_id, made, regexp_replace(coalesce(t, ''), {_ENDS}, '', 'g') AS m FROM {_both_sql(_MARK)})")
def active_speech(spark, sf_dir):
    words = lambda tag: F.regexp_replace("text", r"\S+", tag)
    mark = _case(
        F.col("doc_id") % 7, F.concat(F.lit("<SIL> sil"), V.blanked("text")), V.blanked("text"), words("<_><space>"), words("(sil)"), F.concat(words("sil"), "text"),
        F.lit(None).cast("string"), F.concat(F.lit("  <sil>  "), words("Sil"), F.lit(" <sil")),
    )
    return V.beside(_docs(spark, sf_dir), mark).select("doc_id", "made", F.coalesce(T.is_active_speech(F.col("text")), F.lit(False)).alias("active"))


_ZH = V.HAN_SQL("text")
_RAW = f"""CASE doc_id % 10 WHEN 0 THEN '<sil>' || {V.BLANKED_SQL('text')} WHEN 1 THEN {_ZH} || ' /OVERLAP 吗' WHEN 2 THEN '<->&`' || text WHEN 3 THEN {_ZH} || '<asr_text>你好' WHEN 4 THEN {_ZH} || 'Ａ' WHEN 5 THEN {V.DIGITS_SQL('text')}
  WHEN 6 THEN {_WORDS.format('。')} || '好' WHEN 7 THEN '<SIL> ' || {_ZH} || ' <%> ' || doc_id WHEN 8 THEN {_WORDS.format('<->&`')} ELSE {_ZH} END"""


@query(f"""WITH r AS (SELECT doc_id, made, coalesce(t, '') AS raw FROM {_both_sql(_RAW)}), t AS (SELECT *, regexp_replace(regexp_replace(raw, '<sil>|<\\s*%\\s*>|<->|<\\$>|<#>|<_>|<space>|\\(~\\)|\\(sil\\)|`|&', '', 'gi'), '[{V.SPACE_SQL}]+', '', 'g') AS t,
  regexp_replace(raw, {_ENDS}, '', 'g') AS m FROM r), w AS (SELECT *, CASE WHEN regexp_matches(m, '{_NOT_SILENT}') THEN 'silence_interval' WHEN contains(lower(raw), '/overlap') THEN 'overlap_tag'
  WHEN t = '' THEN 'empty_after_tag_strip' WHEN contains(lower(t), '<asr_text>') OR contains(t, '<|') THEN 'forbidden_prompt_token' WHEN regexp_matches(t, '[A-Za-zＡ-Ｚａ-ｚ]') THEN 'contains_latin_code_switch'
  WHEN NOT regexp_matches(t, '[一-鿿]') THEN 'no_cjk_char' WHEN length(regexp_replace(lower(t), '[\\p{{P}}\\p{{Z}}\\p{{Cc}}]', '', 'g')) < 2 THEN 'empty_or_too_short_text' END AS reason FROM t)
SELECT doc_id, made, CASE WHEN reason IS NULL THEN t END AS cleaned, reason FROM w""")
def transcript_reasons(spark, sf_dir):
    zh, words = V.han("text"), lambda tag: F.regexp_replace("text", r"\S+", tag)
    raw = _case(
        F.col("doc_id") % 10, F.concat(F.lit("<sil>"), V.blanked("text")), F.concat(zh, F.lit(" /OVERLAP 吗")), F.concat(F.lit("<->&`"), "text"), F.concat(zh, F.lit("<asr_text>你好")), F.concat(zh, F.lit("Ａ")),
        V.digits("text"), F.concat(words("。"), F.lit("好")), F.concat(F.lit("<SIL> "), zh, F.lit(" <%> "), _text("doc_id")), words("<->&`"), zh,
    )
    both = V.beside(_docs(spark, sf_dir), raw).withColumn("text", F.coalesce("text", F.lit("")))
    got = both.select("doc_id", "made", T.clean_transcript(F.col("text"), norm=T.normalize_fast).alias("c"))
    return got.select("doc_id", "made", F.col("c.text").alias("cleaned"), F.col("c.reason").alias("reason"))


_NAME = "CASE doc_id % 4 WHEN 0 THEN 'R' || (doc_id % 97) || '_M' || (doc_id % 7) || '_spk' || doc_id || '_x' WHEN 1 THEN '__R1_' || source || '__SPK0' WHEN 2 THEN ' single ' ELSE 'a_' || doc_id END"


@query(f"""SELECT doc_id, CASE WHEN len(parts) >= 2 THEN parts[1] || '_' || parts[2] ELSE trim(name) END AS meeting, nullif(upper(regexp_extract(name, '(?i)(SPK[A-Za-z0-9]+)', 1)), '') AS speaker
FROM (SELECT doc_id, name, list_filter(string_split(trim(name), '_'), lambda p: p <> '') AS parts FROM (SELECT doc_id, {_NAME} AS name FROM documents WHERE source IS NOT NULL))""")
def meeting_and_speaker(spark, sf_dir):
    k, n = F.col("doc_id"), _text("doc_id")
    name = _case(k % 4, F.concat(F.lit("R"), k % 97, F.lit("_M"), k % 7, F.lit("_spk"), n, F.lit("_x")), F.concat(F.lit("__R1_"), "source", F.lit("__SPK0")), " single ", F.concat(F.lit("a_"), n))
    return _docs(spark, sf_dir).where("source is not null").select("doc_id", T.meeting_id(name).alias("meeting"), T.speaker_token(name).alias("speaker"))


@query("""SELECT doc_id, CASE WHEN starts_with(u, 'BAC009S') AND contains(u, 'W') AND regexp_matches(substr(u, 7, 5), '^S[0-9]{4}$') THEN substr(u, 7, 5) END AS speaker
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'BAC009S' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || 'W' || doc_id WHEN 1 THEN 'BAC009S12x4W1' WHEN 2 THEN 'BAC009S0012' ELSE 'BAC008S0012W1' END AS u FROM documents)""")
def utterance_speakers(spark, sf_dir):
    k = F.col("doc_id")
    u = _case(k % 4, F.concat(F.lit("BAC009S"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("W"), k), "BAC009S12x4W1", "BAC009S0012", "BAC008S0012W1")
    return _docs(spark, sf_dir).select("doc_id", T.utterance_speaker(u).alias("speaker"))


_SAID = "CASE doc_id % 4 WHEN 0 THEN text || ' <|im_end|>' WHEN 1 THEN 'language X<asr_text> ' || text || '<asr_text>tail <|endoftext|>' WHEN 2 THEN text ELSE text || '<asr_text>' END"


@query(f"""SELECT doc_id, sha256(regexp_replace(CASE WHEN contains(p, '<asr_text>') THEN substr(p, strpos(p, '<asr_text>') + 10) ELSE p END, '^\\s+|\\s+$', '', 'g')) AS said_sha
FROM (SELECT doc_id, regexp_replace(replace(replace({_SAID}, '<|im_end|>', ''), '<|endoftext|>', ''), '^\\s+|\\s+$', '', 'g') AS p FROM documents)""")
def generation_texts(spark, sf_dir):
    raw = _case(F.col("doc_id") % 4, F.concat("text", F.lit(" <|im_end|>")), F.concat(F.lit("language X<asr_text> "), "text", F.lit("<asr_text>tail <|endoftext|>")), F.col("text"), F.concat("text", F.lit("<asr_text>")))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.generation_text(raw), 256).alias("said_sha"))


_IDS = "([o_orderkey % 5, o_custkey % 3, 7, o_orderkey % 3, o_custkey % 4])[1:o_orderkey % 6]"


def _ids():
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return F.slice(F.array(*[x.cast("long") for x in (k % 5, c % 3, F.lit(7), k % 3, c % 4)]), 1, (k % 6).cast("int"))


@query(f"SELECT o_orderkey, CASE WHEN len(ids) > 0 AND ids[len(ids)] = 2 THEN 'eos' WHEN len(ids) >= 4 THEN 'length' ELSE 'other' END AS stop FROM (SELECT o_orderkey, {_IDS} AS ids FROM orders)")
def stop_reasons(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select("o_orderkey", T.stop_reason(_ids(), 2, 4).alias("stop"))


@query(f"SELECT avg(len(ids))::DOUBLE AS mean_tokens, max(len(ids))::INT AS max_tokens, count(*) FILTER (len(ids) >= 4) AS at_cap FROM (SELECT {_IDS} AS ids FROM orders)")
def decode_stops(spark, sf_dir):
    return A.decode_stops(V.table(spark, sf_dir, "orders").select(_ids().alias("ids")), "ids", 4)


_PLAIN = "regexp_replace(replace(lower({}), 'ß', 'ss'), '[\\p{{P}}\\p{{Z}}\\p{{Cc}}]', '', 'g')"
_BARE = f"CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN {_PLAIN.format('text')} ELSE {_PLAIN.format('text')} || '!' END"


@query(f"SELECT doc_id, made, t = '' OR {_PLAIN.format('t')} <> t AS punctuated FROM {_both_sql(_BARE)}")
def punctuated_texts(spark, sf_dir):
    plain = T.normalize_fast(F.col("text"))
    made = _case(F.col("doc_id") % 3, "", plain, F.concat(plain, F.lit("!")))
    return V.beside(_docs(spark, sf_dir), made).select("doc_id", "made", T.has_punctuation(F.col("text"), T.normalize_fast).alias("punctuated"))


_PATH = "CASE doc_id % 7 WHEN 0 THEN '../a' || doc_id WHEN 1 THEN '/abs/' || doc_id WHEN 2 THEN 'a\\b' WHEN 3 THEN 'a/..b/' || doc_id WHEN 4 THEN '' WHEN 5 THEN 'a/../b' ELSE source || '/' || doc_id || '.wav' END"


@query(f"SELECT doc_id, p <> '' AND NOT regexp_matches(p, '^/|\\\\') AND NOT list_contains(string_split(p, '/'), '..') AS safe FROM (SELECT doc_id, {_PATH} AS p FROM documents)")
def safe_paths(spark, sf_dir):
    n = _text("doc_id")
    p = _case(F.col("doc_id") % 7, F.concat(F.lit("../a"), n), F.concat(F.lit("/abs/"), n), "a\\b", F.concat(F.lit("a/..b/"), n), "", "a/../b", F.concat("source", F.lit("/"), n, F.lit(".wav")))
    return _docs(spark, sf_dir).select("doc_id", T.is_safe_path(p).alias("safe"))


_SID = "CASE doc_id % 5 WHEN 0 THEN source || ':' || doc_id WHEN 1 THEN '.' || doc_id WHEN 2 THEN repeat('x', (doc_id % 90)::INT) WHEN 3 THEN 'ü' || doc_id ELSE 'a b' END"


@query(f"SELECT doc_id, regexp_matches({_SID}, '^[A-Za-z0-9][A-Za-z0-9._:-]{{0,80}}$') AS ok FROM documents")
def source_ids(spark, sf_dir):
    n = _text("doc_id")
    x = _case(F.col("doc_id") % 5, F.concat("source", F.lit(":"), n), F.concat(F.lit("."), n), F.repeat(F.lit("x"), (F.col("doc_id") % 90).cast("int")), F.concat(F.lit("ü"), n), "a b")
    return _docs(spark, sf_dir).select("doc_id", T.is_source_id(x).alias("ok"))


@query(f"""WITH {V.INTERVALS} SELECT id, concat_ws('_', 'alimeeting', meeting, speaker, lpad(round_even(xmin * 100, 0)::BIGINT::VARCHAR, 7, '0'), lpad(round_even(xmax * 100, 0)::BIGINT::VARCHAR, 7, '0')) AS interval_id,
  'u' || id || '__noise' AS sample_id, 'ep' || lpad((id % 1000)::VARCHAR, 3, '0') || '_v' || lpad((id % 100000)::VARCHAR, 6, '0') || '_s' AS visit_id, 'step_' || lpad((id % 9999)::VARCHAR, 6, '0') AS step FROM intervals""")
def composite_ids(spark, sf_dir):
    k = F.col("id")
    return V.intervals(spark, sf_dir).select(
        "id", T.interval_id(F.col("meeting"), F.col("speaker"), F.col("xmin"), F.col("xmax")).alias("interval_id"), T.sample_id(F.concat(F.lit("u"), k), F.lit("noise")).alias("sample_id"),
        T.visit_id(k % 1000, k % 100000, F.lit("s")).alias("visit_id"), T.step_name(k % 9999).alias("step"),
    )


# --- sequences, token arrays, numbers -----------------------------------------------------------


@query("""SELECT o_orderkey, len(list_filter(range(0, n), lambda i: i % 3 = 0 AND i / n::DOUBLE BETWEEN 0.40 AND 0.55))::INT AS gaps FROM (SELECT o_orderkey, o_orderkey % 40 + 1 AS n FROM orders)""")
def gap_insertions(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").withColumn("n", (F.col("o_orderkey") % 40 + 1).cast("int"))
    ops = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.when(i % 3 == 0, "insert").otherwise("match").alias("op"), i.alias("ref_index"), i.alias("hyp_index")))
    return o.select("o_orderkey", S.gap_insertions(ops, F.col("n")).alias("gaps"))


@query("""SELECT o_orderkey, CASE WHEN length(a) = length(b) THEN len(list_filter(range(1, length(a) + 1), lambda i: a[i:i] <> b[i:i]))::INT END AS differ
FROM (SELECT o_orderkey, o_orderpriority AS a, CASE o_orderkey % 3 WHEN 0 THEN reverse(o_orderpriority) WHEN 1 THEN replace(o_orderpriority, '00', '1') ELSE translate(o_orderpriority, '01', '10') END AS b FROM orders)""")
def hamming_counts(spark, sf_dir):
    b = _case(F.col("o_orderkey") % 3, F.reverse("o_orderpriority"), F.replace("o_orderpriority", F.lit("00"), F.lit("1")), F.translate("o_orderpriority", "01", "10"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", S.hamming(F.col("o_orderpriority"), b).alias("differ"))


@query("""SELECT o_orderkey, array_to_string(CASE WHEN list_contains(m, 1) THEN m ELSE [1, 1, 1] END, '') AS mask FROM (SELECT o_orderkey, list_transform(range(1, 4),
  lambda i: CASE WHEN ([o_orderkey % 3, o_orderkey % 5, 4])[i] <> ([o_orderkey % 3, o_custkey % 5, 4])[i] THEN 1 ELSE 0 END) AS m FROM orders)""")
def mismatch_masks(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b = (F.array((k % 3).cast("long"), (x % 5).cast("long"), F.lit(4).cast("long")) for x in (k, c))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(S.mismatch_mask(a, b), lambda x: x.cast("int").cast("string")), "").alias("mask"))


_LABELS = """SELECT o_orderkey, list_transform(range(0, 6), lambda i: CASE WHEN i < o_orderkey % 4 OR ([1, 1, 1, 1, o_custkey % 2, 0])[i + 1] = 0 THEN -100 ELSE ([o_orderkey % 9, 1, o_custkey % 9, 3, 4, 5])[i + 1] END) AS l FROM orders"""


@query(f"SELECT o_orderkey, array_to_string(l, ',') AS labels, array_to_string(list_filter(l[2:], lambda x: x <> -100), ',') AS trained FROM ({_LABELS})")
def label_masks(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    long = lambda *xs: F.array(*[(x if hasattr(x, "cast") else F.lit(x)).cast("long") for x in xs])
    labels = S.label_mask(long(k % 9, 1, c % 9, 3, 4, 5), k % 4, long(1, 1, 1, 1, c % 2, 0))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", text(labels).alias("labels"), text(S.shifted_labels(labels)).alias("trained"))


@query("SELECT sha256(string_agg(n_name || chr(9) || sha256(n_regionkey::VARCHAR) || chr(10), '' ORDER BY n_name)) AS tree_sha256 FROM nation")
def tree_digest(spark, sf_dir):
    return hashing.tree_sha(V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.sha2(_text("n_regionkey"), 256).alias("sha256")))


@query(f"""WITH {V.PREFERENCES} SELECT pair_id, round((greatest(0, exp(policy_logp[1]) * (policy_logp[1] - reference_logp[1]) + exp(policy_logp[2]) * (policy_logp[2] - reference_logp[2]))
  + greatest(0, exp(chosen_logp) * (chosen_logp - ref_chosen_logp))) / 2, 9) AS kl FROM preferences""")
def exact_divergence(spark, sf_dir):
    p = F.array("policy_logp", F.array("chosen_logp"))
    r = F.array("reference_logp", F.array("ref_chosen_logp"))
    return V.preferences(spark, sf_dir).select("pair_id", F.round(maths.exact_kl(p, r), 9).alias("kl"))


@query("SELECT doc_id, CASE WHEN isfinite(s) THEN round_even(s * 1000, 0)::BIGINT END AS ms FROM (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE length(text) / 2048.0::DOUBLE END AS s FROM documents)")
def duration_rounding(spark, sf_dir):
    s = _case(F.col("doc_id") % 11, F.lit(float("nan")), F.lit(float("inf")), F.length("text") / 2048.0)
    return _docs(spark, sf_dir).select("doc_id", maths.duration_ms(s).alias("ms"))


@query(f"WITH {V.PREFERENCES} SELECT pair_id, round(-(policy_logp[1] + policy_logp[2] + chosen_logp), 9) AS logp FROM preferences")
def sequence_logprobs(spark, sf_dir):
    return V.preferences(spark, sf_dir).select("pair_id", F.round(maths.sequence_logprob(F.concat("policy_logp", F.array("chosen_logp"))), 9).alias("logp"))


@query("SELECT o_orderkey, o_orderkey % 7000 > (60 - 10) * 60 AS over, o_orderkey % 500 > 0 AND ((o_orderkey % 500) % 20 = 0 OR o_orderkey % 500 >= 480) AS due FROM orders")
def schedule_predicates(spark, sf_dir):
    k = F.col("o_orderkey")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", maths.over_budget(k % 7000, 60, 10).alias("over"), maths.evaluation_due(k % 500, 20, 480).alias("due"))


@query("SELECT DISTINCT s AS step FROM (SELECT o_orderkey % 500 AS s FROM orders) WHERE s > 0 AND (s % 20 = 0 OR s >= 480) AND s NOT IN (SELECT o_custkey % 500 FROM orders WHERE o_custkey % 3 = 0)")
def undecided_steps(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    steps = o.select((F.col("o_orderkey") % 500).alias("step")).distinct()
    return logs.undecided(steps, o.where("o_custkey % 3 = 0").select((F.col("o_custkey") % 500).alias("step")).distinct(), 20, 480)


@query("SELECT s_suppkey AS step FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 3) AND s_suppkey <> 2")
def pruned_checkpoints(spark, sf_dir):
    return windows.prune_checkpoints(V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("step")), 3, 2)


# --- manifests ------------------------------------------------------------------------------------

_OFFICIAL = """o AS (SELECT doc_id, doc_id % 3 <> 0 AS touched, CASE doc_id % 10 WHEN 1 THEN '' WHEN 2 THEN 'bad id' ELSE 'S' || doc_id END AS speaker_id,
  CASE doc_id % 7 WHEN 1 THEN NULL WHEN 2 THEN 'eval' WHEN 3 THEN 'dev' ELSE 'train' END AS official_split, CASE doc_id % 5 WHEN 1 THEN '!' WHEN 2 THEN NULL ELSE 'pkg' END AS source_package FROM documents)"""


def _official(spark, sf_dir):
    k = F.col("doc_id")
    null = F.lit(None).cast("string")
    return _docs(spark, sf_dir).select(
        "doc_id", (k % 3 != 0).alias("touched"), F.when(k % 10 == 1, "").when(k % 10 == 2, "bad id").otherwise(F.concat(F.lit("S"), k)).alias("speaker_id"),
        F.when(k % 7 == 1, null).when(k % 7 == 2, "eval").when(k % 7 == 3, "dev").otherwise("train").alias("official_split"), F.when(k % 5 == 1, "!").when(k % 5 == 2, null).otherwise("pkg").alias("source_package"),
    )


@query(f"""WITH {_OFFICIAL} SELECT doc_id, CASE WHEN NOT touched THEN NULL WHEN speaker_id = '' OR official_split IS NULL THEN 'incomplete_official_identity' WHEN speaker_id = 'bad id' THEN 'bad_speaker_id'
  WHEN official_split = 'eval' THEN 'bad_official_split' WHEN source_package = '!' THEN 'bad_source_package' END AS reason FROM o""")
def official_identity(spark, sf_dir):
    return _official(spark, sf_dir).select("doc_id", manifest.official_problem(F.col("touched")).alias("reason"))


@query(f"WITH {_OFFICIAL} SELECT CASE WHEN count(*) FILTER (touched) = 0 THEN 'hash' WHEN count(*) FILTER (touched) = count(*) THEN 'official' ELSE 'mixed_split_mode' END AS mode FROM o")
def split_mode(spark, sf_dir):
    return manifest.split_mode(_official(spark, sf_dir), F.col("touched"))


@query(_PROBLEMS + " SELECT code, count(*) AS n FROM p GROUP BY code")
def problem_counters(spark, sf_dir):
    return A.reason_counts(manifest.manifest_problems(_manifest(spark, sf_dir)), "code")


_FAILING = f"""WITH {V.SOURCES}, r AS (SELECT line AS source_id, s, s || '_failed' AS why, (line * (n + 3)) % 17 = 1 AS bad, n, ('0x' || substr(sha256('7:' || line || ':' || s), 1, 8))::BIGINT AS seed
  FROM sources, (VALUES ('clean', 1), ('noise', 2), ('reverb', 3), ('far_field', 4), ('dropout', 5)) t(s, n))"""


def _scenarios(spark, sf_dir):
    sources = V.sources(spark, sf_dir).select(F.col("line").cast("string").alias("source_id"))
    n = F.array_position(F.array(*[F.lit(s) for s in T.SCENARIOS]), F.col("scenario"))
    failed = F.when((F.col("source_id").cast("long") * (n + 3)) % 17 == 1, F.concat("scenario", F.lit("_failed")))
    return manifest.scenario_rows(sources, 7, failed)


@query(_FAILING + " SELECT source_id || '__' || s AS sample_id, s AS scenario, seed FROM r WHERE source_id NOT IN (SELECT source_id FROM r WHERE bad)")
def scenario_rows(spark, sf_dir):
    return _scenarios(spark, sf_dir)[0].select("sample_id", "scenario", "seed")


@query(_FAILING + " SELECT source_id::VARCHAR AS source_id, arg_min(why, n) AS reason FROM r WHERE bad GROUP BY source_id")
def scenario_failures(spark, sf_dir):
    return _scenarios(spark, sf_dir)[1].select("source_id", "reason")


@query(f"""WITH {V.SOURCES} SELECT 'k' || line AS source_utterance_id, 'wav/' || speaker_id || '/k' || line || '.wav' AS audio, text, 'zh' AS language, speaker_id, 'train' AS official_split FROM sources""")
def builder_rows(spark, sf_dir):
    s = V.sources(spark, sf_dir).withColumns({"utterance_id": F.concat(F.lit("k"), "line"), "official_split": F.lit("train")})
    return manifest.builder_rows(s, "wav")


@query(f"""WITH {V.SOURCES} SELECT 'r1' AS schema_version, CASE WHEN regexp_matches(source_id, '^[A-Za-z0-9][A-Za-z0-9._:-]{{0,80}}$') THEN source_id ELSE 'line-' || line END AS sample_id, 'empty_text' AS reason FROM sources WHERE {V.BLANK_SQL('text')}""")
def reject_rows(spark, sf_dir):
    return timeline.rejects(V.sources(spark, sf_dir).withColumn("reason", F.when(T.is_blank(F.col("text")), "empty_text")), "source_id", "r1")


@query(f"""WITH {V.INTERVALS} SELECT s || '__' || t AS sample_id, t AS scenario, round(xmax - xmin, 6) AS duration_sec FROM (SELECT *, concat_ws('_', 'alimeeting', meeting, speaker, lpad(round_even(xmin * 100, 0)::BIGINT::VARCHAR, 7, '0'),
  lpad(round_even(xmax * 100, 0)::BIGINT::VARCHAR, 7, '0')) AS s FROM intervals), (VALUES ('near_field'), ('far_field')) u(t)""")
def twin_rows(spark, sf_dir):
    return timeline.twin_rows(V.intervals(spark, sf_dir)).select("sample_id", "scenario", F.round("duration_sec", 6).alias("duration_sec"))


# --- pairs and predictions ----------------------------------------------------------------------


@query(f"WITH {V.SAMPLES} SELECT sample_id FROM samples WHERE scenario = 'dropout' AND (CASE WHEN line % 9 = 0 THEN NULL ELSE split END IS NULL OR split = 'train') AND trim(prediction) <> ''")
def dropout_anchors(spark, sf_dir):
    s = V.samples(spark, sf_dir).withColumns({"rejected_text": F.col("prediction"), "split": F.when(F.col("line") % 9 != 0, F.col("split"))})
    return pairs.dropout_anchors(s).select("sample_id")


_ALIGNED = """SELECT o_orderkey, c, CASE o_orderkey % 5 WHEN 0 THEN c WHEN 1 THEN translate(c, '0', '1') WHEN 2 THEN substr(c, 2) || 'z' WHEN 3 THEN c || '!' ELSE translate(c, 'abc', 'bcd') END AS r
  FROM (SELECT o_orderkey, substr(sha256(o_orderkey::VARCHAR), 1, 14) AS c FROM orders)"""


@query(f"""SELECT o_orderkey FROM (SELECT *, len(list_filter(range(1, length(c) + 1), lambda i: c[i:i] <> r[i:i])) AS h FROM ({_ALIGNED})) WHERE NOT contains(r, '!') AND length(c) = length(r) AND h BETWEEN 1 AND 3
  AND levenshtein(c, r) <= 3 AND h = levenshtein(c, r)""")
def aligned_substitutions(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", F.substring(F.sha2(_text("o_orderkey"), 256), 1, 14).alias("chosen_text"))
    c = F.col("chosen_text")
    o = o.withColumn("rejected_text", _case(F.col("o_orderkey") % 5, c, F.translate(c, "0", "1"), F.concat(F.substring(c, 2, 99), F.lit("z")), F.concat(c, F.lit("!")), F.translate(c, "abc", "bcd")))
    r = F.col("rejected_text")
    o = o.withColumns({"char_length_delta": F.length(r) - F.length(c), "chosen_token_count": F.length(c) + 1, "rejected_token_count": F.length(r) + 1, "edit_count": F.levenshtein(c, r)})
    return o.where(pairs.aligned_substitution(3, T.normalize_fast)).select("o_orderkey")


_TRAINING = f"""WITH {V.SAMPLES}, m AS (SELECT CASE WHEN line % 71 = 0 THEN 'twice' ELSE sample_id END AS pair_id, CASE WHEN line % 73 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN line % 79 = 0 THEN 'odd' ELSE scenario END AS scenario,
  reference, CASE WHEN line % 83 = 0 THEN 'other' ELSE reference END AS chosen_text, prediction AS rejected_text, CASE WHEN line % 89 = 0 THEN 'NaN'::DOUBLE ELSE -1.5 END AS ref_chosen_logp, CASE WHEN line % 97 = 0 THEN NULL ELSE -2.5::DOUBLE END AS ref_rejected_logp,
  length(reference) + 1 AS chosen_token_count, CASE WHEN line % 101 = 0 THEN 0 ELSE 4 END AS rejected_token_count, CASE WHEN line % 103 = 0 THEN NULL ELSE 1 END AS char_length_delta FROM samples)"""


def _training(spark, sf_dir):
    k = F.col("line")
    return V.samples(spark, sf_dir).select(
        F.when(k % 71 == 0, "twice").otherwise(F.col("sample_id")).alias("pair_id"), F.when(k % 73 == 0, "val").otherwise("train").alias("split"), F.when(k % 79 == 0, "odd").otherwise(F.col("scenario")).alias("scenario"),
        "reference", F.when(k % 83 == 0, "other").otherwise(F.col("reference")).alias("chosen_text"), F.col("prediction").alias("rejected_text"), F.when(k % 89 == 0, float("nan")).otherwise(-1.5).alias("ref_chosen_logp"),
        F.when(k % 97 != 0, -2.5).alias("ref_rejected_logp"), (F.length("reference") + 1).alias("chosen_token_count"), F.when(k % 101 == 0, 0).otherwise(4).alias("rejected_token_count"), F.when(k % 103 != 0, 1).alias("char_length_delta"),
    )


@query(_TRAINING + """ SELECT 'bad_split' AS code, pair_id AS key FROM m WHERE split <> 'train' UNION ALL SELECT 'bad_scenario', pair_id FROM m WHERE scenario = 'odd' UNION ALL SELECT 'chosen_is_not_reference', pair_id FROM m WHERE chosen_text <> reference
  UNION ALL SELECT 'blank_rejected', pair_id FROM m WHERE trim(rejected_text) = '' UNION ALL SELECT 'logp_not_finite', pair_id FROM m WHERE isnan(ref_chosen_logp) OR ref_rejected_logp IS NULL UNION ALL SELECT 'token_count', pair_id FROM m WHERE rejected_token_count < 1
  UNION ALL SELECT 'no_length_delta', pair_id FROM m WHERE char_length_delta IS NULL UNION ALL SELECT 'duplicate_pair', pair_id FROM m GROUP BY pair_id HAVING count(*) > 1 UNION ALL SELECT 'scenario_floor', scenario FROM m GROUP BY scenario HAVING count(*) < 50""")
def pair_problems(spark, sf_dir):
    return pairs.pair_problems(_training(spark, sf_dir), "train", 50)


@query(f"WITH {V.PREFERENCES} SELECT pair_id, ref_chosen_logp, ref_rejected_logp, char_length_delta FROM preferences")
def filled_logprobs(spark, sf_dir):
    p = V.preferences(spark, sf_dir)
    bare = p.select("pair_id", "char_length_delta").withColumns({"ref_chosen_logp": F.lit(None).cast("double"), "ref_rejected_logp": F.lit(None).cast("double")})
    return pairs.fill_logprobs(bare, p).select("pair_id", "ref_chosen_logp", "ref_rejected_logp", "char_length_delta")


@query(f"""WITH {V.PREFERENCES}, m AS (SELECT unnest([[ref_chosen_logp, ref_chosen_logp + (pair_id % 3) * 1e-5], [ref_rejected_logp, ref_rejected_logp - (pair_id % 2) * 1e-6]]) AS v FROM preferences)
SELECT round(max(abs(v[1] - v[2])), 9) AS max_abs_error, round(max(CASE WHEN greatest(abs(v[1]), abs(v[2])) = 0 THEN 0 ELSE abs(v[1] - v[2]) / greatest(abs(v[1]), abs(v[2])) END), 6) AS max_rel_error, false AS ok FROM m""")
def cache_recheck(spark, sf_dir):
    p = V.preferences(spark, sf_dir)
    fresh = p.select("pair_id", (F.col("ref_chosen_logp") + (F.col("pair_id") % 3) * 1e-5).alias("ref_chosen_logp"), (F.col("ref_rejected_logp") - (F.col("pair_id") % 2) * 1e-6).alias("ref_rejected_logp"))
    got = pairs.recheck(p, fresh)
    return got.select(F.round("max_abs_error", 9).alias("max_abs_error"), F.round("max_rel_error", 6).alias("max_rel_error"), "ok")


@query(f"""WITH {V.SAMPLES}, w AS (SELECT sample_id AS pair_id, row_number() OVER (ORDER BY line) AS n FROM samples), c AS (SELECT n, CASE WHEN n % 50 = 0 THEN 'other' ELSE pair_id END AS pair_id, CASE WHEN n % 60 = 0 THEN NULL ELSE -1.0 END AS x FROM w WHERE n <= 200
  UNION ALL SELECT n, pair_id, -1.0 FROM w WHERE n IN (3, 7)) SELECT n AS line, 'not_the_wanted_row' AS problem FROM c WHERE pair_id = 'other' UNION ALL SELECT n, 'done_twice' FROM c GROUP BY n HAVING count(*) > 1 UNION ALL SELECT n, 'not_finite' FROM c WHERE x IS NULL""")
def cache_problems(spark, sf_dir):
    w = windows.global_index(V.samples(spark, sf_dir).select(F.col("sample_id").alias("pair_id"), "line"), ["line"], "_line").select("pair_id", "_line")
    n = F.col("_line")
    cache = w.where("_line <= 200").select("_line", F.when(n % 50 == 0, "other").otherwise(F.col("pair_id")).alias("pair_id"), F.when(n % 60 != 0, -1.0).alias("ref_chosen_logp"))
    cache = cache.unionByName(w.where("_line in (3, 7)").withColumn("ref_chosen_logp", F.lit(-1.0))).withColumn("ref_rejected_logp", F.lit(-2.0))
    return logs.cache_problems(w, cache).select(F.col("_line").alias("line"), "problem")


_PREDICTED = f"""WITH {V.SAMPLES} SELECT sample_id, CASE WHEN failed THEN NULL ELSE prediction END AS prediction_raw, CASE WHEN failed THEN 'error' ELSE stop_reason END AS stop_reason, CASE WHEN failed THEN error END AS error,
  CASE WHEN failed THEN NULL ELSE line % 4 <> 0 END AS transcribe_matches_greedy FROM (SELECT *, coalesce(trim(error), '') <> '' AS failed FROM samples)"""


def _predicted(spark, sf_dir):
    s = V.samples(spark, sf_dir).withColumns({
        "audio": F.lit("w.wav"), "language": F.lit("zh"), "text": F.col("reference"), "prediction_raw": F.col("prediction"), "generation_raw": F.col("prediction"), "token_ids": F.array(F.lit(1)),
        "transcribe_text": F.when(F.col("line") % 4 == 0, F.lit("~")).otherwise(F.col("prediction")),
    })
    return timeline.prediction_rows(s, "m", 42)


@query(_PREDICTED)
def prediction_rows(spark, sf_dir):
    return _predicted(spark, sf_dir).select("sample_id", "prediction_raw", "stop_reason", "error", "transcribe_matches_greedy")


@query(f"SELECT sample_id, prediction_raw, stop_reason, coalesce(error, '') AS error FROM ({_PREDICTED})")
def greedy_map(spark, sf_dir):
    return timeline.greedy_map(_predicted(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'mismatch' END AS problem FROM documents""")
def audio_against_index(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("wav/"), "doc_id").alias("audio"), F.sha2(_text("doc_id"), 256).alias("sha256"))
    index = d.where("doc_id % 6 <> 0").select(F.col("audio").alias("name"), F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("sha256")).alias("sha256"))
    return joins.against_index(d, index).select("doc_id", "problem")


@query("""SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 4 <> 0""")
def attached_metadata(spark, sf_dir):
    meta = V.table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    return joins.attach(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), meta, "o_custkey").select("o_orderkey", "c_name", "c_nationkey")


@query("""WITH n AS (SELECT 'near/' || o_orderkey AS path, 's' || o_orderkey AS stem, 'm' || (o_orderkey % 50) AS meeting FROM orders), g AS (SELECT 's' || o_orderkey AS stem, 'grid/' || o_orderkey AS grid FROM orders WHERE o_orderkey % 3 <> 0),
f AS (SELECT 'far/' || o_orderkey AS far, 's' || o_orderkey AS stem, 'm' || (o_orderkey % 50) AS meeting FROM orders WHERE o_orderkey % 50 < 30 OR o_orderkey % 7 = 0), fm AS (SELECT meeting, min(far) AS x FROM f WHERE meeting NOT IN ('m49') GROUP BY 1)
SELECT path, grid, coalesce(fm.x, f.far) AS far FROM n LEFT JOIN g USING (stem) LEFT JOIN fm USING (meeting) LEFT JOIN f USING (stem)""")
def files_by_stem(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    path = lambda name, rows: rows.select(F.concat(F.lit(f"{name}/"), k).alias("path"))
    number = F.regexp_extract("path", "([0-9]+)$", 1)
    meeting = F.concat(F.lit("m"), number.cast("long") % 50)
    far = path("far", o.where((k % 50 < 30) | (k % 7 == 0)))
    # the meeting m49 has no far recording under its own name
    named = F.when((meeting == "m49") & F.col("path").startswith("far"), "none").otherwise(meeting)
    return joins.files_by_stem(path("near", o), path("grid", o.where(k % 3 != 0)), far, F.concat(F.lit("s"), number), named).select("path", "grid", "far")


# --- aggregates and gates -----------------------------------------------------------------------


@query(f"WITH {V.PREFERENCES} SELECT round(avg((chosen_logp > rejected_logp)::INT), 9) AS raw_policy_accuracy FROM preferences")
def raw_preference(spark, sf_dir):
    return A.raw_preference(V.preferences(spark, sf_dir)).select(F.round("raw_policy_accuracy", 9).alias("raw_policy_accuracy"))


_GROUPS = f"""WITH {V.PREFERENCES}, g AS (SELECT group_id, substr(group_id, 2)::BIGINT // 8 AS window_id, bool_and(coalesce(trim(error), '') = '' AND stop_reason = 'eos') AS valid, min(reward) = max(reward) AS zero_advantage, avg(chosen_logp) AS group_loss FROM preferences GROUP BY group_id)"""


@query(_GROUPS + """ SELECT window_id, count(*) FILTER (valid) AS valid_groups, count(*) FILTER (NOT valid) AS invalid_groups, count(*) FILTER (valid AND NOT zero_advantage) AS signal_groups, count(*) FILTER (valid AND zero_advantage) AS zero_groups,
  count(*) FILTER (valid AND NOT zero_advantage) > 0 AS steps, round(avg(group_loss) FILTER (valid), 9) AS loss FROM g GROUP BY window_id""")
def window_summary(spark, sf_dir):
    p = V.preferences(spark, sf_dir)
    rest = p.groupBy("group_id").agg((F.min("reward") == F.max("reward")).alias("zero_advantage"), F.avg("chosen_logp").alias("group_loss"))
    g = A.group_validity(p, "group_id").join(rest, "group_id").withColumn("window_id", F.floor(F.substring("group_id", 2, 99).cast("long") / 8))
    return A.window_summary(g, "window_id").withColumn("loss", F.round("loss", 9))


@query(f"""WITH {V.PREFERENCES} SELECT group_id, round(coalesce(sum(reward * (pair_id % 4)) / nullif(sum(pair_id % 4), 0), 0), 9) AS value, sum(pair_id % 4)::BIGINT AS tokens FROM preferences GROUP BY group_id""")
def token_weighted(spark, sf_dir):
    p = V.preferences(spark, sf_dir).withColumns({"n": F.col("pair_id") % 4, "t": F.col("reward") * (F.col("pair_id") % 4)})
    return A.token_weighted(p, "t", "n", ["group_id"]).withColumn("value", F.round("value", 9))


@query(f"""WITH {V.SCORED}, d AS (SELECT sum(CASE WHEN line % 5 = 1 THEN 1 ELSE 0 END) AS gap_insertions, sum(length(p))::DOUBLE / sum(length(r)) AS length_ratio FROM scored WHERE scenario = 'dropout')
SELECT gap_insertions::BIGINT AS gap_insertions, round(length_ratio, 9) AS length_ratio, CASE WHEN gap_insertions >= 30 AND length_ratio < 0.75 THEN 'MIXED' WHEN gap_insertions >= 30 THEN 'GAP_INSERT' WHEN length_ratio < 0.75 THEN 'EARLY_DELETE' ELSE 'QUIET' END AS signature FROM d""")
def dropout_signature(spark, sf_dir):
    s = V.samples(spark, sf_dir).where("scenario = 'dropout'")
    rows = s.select(F.when(F.col("line") % 5 == 1, 1).otherwise(0).alias("gap_insertions"), F.length(T.normalize_fast(F.col("prediction"))).alias("hyp_chars"), F.length(T.normalize_fast(F.col("reference"))).alias("ref_chars"))
    return A.dropout_signature(rows, 0.001, 0.0).withColumn("length_ratio", F.round("length_ratio", 9))


def _metrics(spark, sf_dir):
    """Metrics of the five scenarios and overall from how many orders each priority has."""
    o = V.table(spark, sf_dir, "orders")
    name = F.element_at(F.array(*[F.lit(s) for s in (*V.SCENARIOS, "overall")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    m = o.groupBy(name.alias("scenario")).agg(F.count("*").alias("samples"), (F.sum(F.col("o_custkey") % 7) / F.sum(F.lit(100))).alias("micro_cer"))
    return m.withColumns({"empty_rate": F.lit(0.01), "repeated_rate": F.when(F.col("scenario") == "noise", 0.2).otherwise(0.0), "long_rate": F.lit(0.0), "truncation_rate": F.lit(0.1), "valid_output_rate": F.lit(0.95)})


_GATED = """m AS (SELECT (['clean', 'dropout', 'far_field', 'noise', 'reverb', 'overall'])[o_orderkey % 6 + 1] AS scenario, count(*) AS samples, sum(o_custkey % 7)::DOUBLE / sum(100) AS micro_cer FROM orders GROUP BY 1),
x AS (SELECT scenario, CASE WHEN scenario IN ('clean', 'dropout') THEN 0.03 ELSE -0.001 END::DOUBLE AS delta FROM m),
v AS (SELECT 'repeated_rate' AS code, 'noise' AS scope, 0.2::DOUBLE AS value UNION ALL SELECT 'rows', scenario, samples::DOUBLE FROM m WHERE scenario <> 'overall' AND samples < 50
  UNION ALL SELECT 'clean_increase', scenario, delta FROM x WHERE scenario = 'clean' UNION ALL SELECT 'clean_increase_vs_base', scenario, 0.05 FROM x WHERE scenario = 'clean'
  UNION ALL SELECT 'scenario_increase', scenario, delta FROM x WHERE scenario = 'dropout' UNION ALL SELECT 'macro_increase', 'degraded', (0.03 - 3 * 0.001) / 4)"""

_LIMITS = {
    "min_rows_per_scenario": 50, "empty_rate_max": 0.05, "repeated_rate_max": 0.05, "long_rate_max": 0.05, "truncation_rate_max": 0.2, "valid_output_rate_min": 0.9, "clean_cer_increase_max": 0.01,
    "clean_cer_increase_vs_base_max": 0.02, "scenario_cer_increase_max": 0.02, "degraded_macro_increase_max": 0.0, "min_preference_accuracy": 0.55, "min_val_pairs": 100, "raw_kl_max": 0.05, "reward_drop_stop": 0.02,
}


def _parents(m):
    """The parent's and the base's metrics."""
    parent = m.withColumn("micro_cer", F.col("micro_cer") - F.when(F.col("scenario").isin("clean", "dropout"), 0.03).otherwise(-0.001))
    return parent, m.withColumn("micro_cer", F.col("micro_cer") - 0.05)


_HELD = "d AS (SELECT (pair_id * 7919) % 1000 - (pair_id * 104729) % 1000 AS d FROM preferences WHERE substr(group_id, 2)::BIGINT % 50 = 1)"


@query(f"WITH {V.PREFERENCES}, {_HELD}, {_GATED} SELECT code, scope, round(value, 9) AS value FROM v UNION ALL SELECT * FROM (SELECT 'preference_accuracy', 'preference', round((count(*) FILTER (d > 0) + 0.5 * count(*) FILTER (d = 0)) / count(*), 9) AS a FROM d) WHERE NOT (a >= 0.55 AND a > 0.5) UNION ALL SELECT 'val_pairs', 'preference', count(*) FROM d HAVING count(*) < 100")
def dpo_gate(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    # a validation split of one customer in fifty
    held = V.preferences(spark, sf_dir).where("cast(substring(group_id, 2) as long) % 50 = 1")
    preference = A.preference_accuracy(held.withColumn("d", (F.col("pair_id") * 7919) % 1000 - (F.col("pair_id") * 104729) % 1000), "d").select("accuracy", "pairs")
    return gates.dpo_violations(m, *_parents(m), _LIMITS, preference).withColumn("value", F.round("value", 9))


_RUN = """r AS (SELECT avg(reward - 0.1 * candidate_index) FILTER (candidate_index = 5) - avg(reward) FILTER (candidate_index = 0) AS drop, bool_and(pair_id % 211 <> 7) AS same,
  avg(((exp(reference_logp[1] - policy_logp[1]) - 1 - (reference_logp[1] - policy_logp[1])) + (exp(reference_logp[2] - policy_logp[2]) - 1 - (reference_logp[2] - policy_logp[2]))) / 2) AS kl FROM preferences)"""


@query(f"WITH {V.PREFERENCES}, {_RUN}, {_GATED} SELECT code, scope, round(value, 9) AS value FROM v UNION ALL SELECT 'reference_changed', 'run', 1 FROM r WHERE NOT same UNION ALL SELECT 'raw_kl', 'run', round(kl, 9) FROM r WHERE kl > 0.05 UNION ALL SELECT 'reward_drop', 'run', round(drop, 9) FROM r WHERE drop < -0.02")
def rl_gate(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    at = lambda k, c: F.avg(F.when(F.col("candidate_index") == k, c))
    cached = F.col("ref_chosen_logp") + F.when(F.col("pair_id") % 211 == 7, 0.01).otherwise(0.0)
    run = V.preferences(spark, sf_dir).agg(
        at(0, F.col("reward")).alias("step0_reward"), at(5, F.col("reward") - 0.1 * F.col("candidate_index")).alias("reward"),
        F.avg(maths.k3(F.col("policy_logp"), F.col("reference_logp"))).alias("raw_kl"), F.every(maths.matches_within(F.col("ref_chosen_logp"), cached)["ok"]).alias("reference_matched"),
    )
    return gates.rl_violations(m, *_parents(m), _LIMITS, run).withColumn("value", F.round("value", 9))


@query("SELECT o_orderkey % 5000 AS step, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <> 1")
def decisions_per_step(spark, sf_dir):
    return gates.one_decision_per_step(V.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000).alias("step")))


@query("""SELECT release, problem FROM (SELECT CASE WHEN s_suppkey % 11 = 3 THEN '' ELSE 'r' || s_suppkey END AS release, CASE WHEN s_suppkey % 5 = 0 THEN 'not_published' WHEN s_suppkey % 7 = 0 THEN 'not_publishable' WHEN s_suppkey % 11 = 3 THEN 'no_id' WHEN s_suppkey % 13 = 0 THEN 'bad_sha' END AS problem FROM supplier)
WHERE problem IS NOT NULL""")
def unpublishable_releases(spark, sf_dir):
    k = F.col("s_suppkey")
    rel = V.table(spark, sf_dir, "supplier").select(
        F.when(k % 11 == 3, "").otherwise(F.concat(F.lit("r"), k)).alias("release"), F.when(k % 5 == 0, "staged").otherwise("published").alias("status"), (k % 7 != 0).alias("publishable"),
        F.when(k % 13 == 0, "ABC").otherwise(F.sha2(_text("s_suppkey"), 256)).alias("adapter_sha"),
    )
    return gates.publishable(rel)


# --- contracts --------------------------------------------------------------------------------------


@query(_MANIFEST + """, t AS (SELECT CASE WHEN line % 7 = 0 THEN 'en' ELSE 'zh' END AS language, m.sample_id, m.text, CASE WHEN line % 13 = 0 THEN '' ELSE m.audio END AS audio FROM m JOIN (SELECT DISTINCT sample_id, line FROM samples) s ON s.sample_id = m.sample_id)
SELECT sample_id AS key, 'language' AS code FROM t WHERE language <> 'zh' UNION ALL SELECT sample_id, 'blank_text' FROM t WHERE trim(text) = '' UNION ALL SELECT sample_id, 'blank_audio' FROM t WHERE trim(audio) = ''
UNION ALL SELECT sample_id, 'duplicate_sample' FROM t GROUP BY sample_id HAVING count(*) > 1""")
def training_row_problems(spark, sf_dir):
    k = V.samples(spark, sf_dir).select("sample_id", "line")
    rows = _manifest(spark, sf_dir).join(k, "sample_id").withColumns({"language": F.when(F.col("line") % 7 == 0, "en").otherwise("zh"), "audio": F.when(F.col("line") % 13 == 0, "").otherwise(F.col("audio"))})
    return manifest.training_row_problems(rows).select("key", "code")


@query(_MANIFEST + """ SELECT split, source_id, position FROM (SELECT split, source_id, row_number() OVER (PARTITION BY split ORDER BY sha256('42:' || source_id || ':smoke'), source_id) AS position
  FROM (SELECT split, source_id FROM m WHERE scenario IN ('clean', 'noise', 'reverb', 'far_field', 'dropout') GROUP BY 1, 2 HAVING count(DISTINCT scenario) = 5)) WHERE position <= 6""")
def smoke_sources(spark, sf_dir):
    return manifest.smoke_sources(_manifest(spark, sf_dir), 42, 6).select("split", "source_id", "position")


@query(_MANIFEST + """, n AS (SELECT split, scenario, count(*) AS n FROM m GROUP BY 1, 2), s AS (SELECT split, scenario, n + CASE WHEN scenario = 'noise' THEN 1 ELSE 0 END AS n FROM n WHERE scenario <> 'odd' UNION ALL SELECT 'gone', 'clean', 4)
SELECT coalesce(s.split, n.split) || '/' || coalesce(s.scenario, n.scenario) AS key, CASE WHEN s.n IS NULL THEN 'not_stored' WHEN n.n IS NULL THEN 'not_computed' ELSE 'differs' END AS problem
FROM s FULL JOIN n ON s.split = n.split AND s.scenario = n.scenario WHERE s.n IS DISTINCT FROM n.n""")
def stored_summary(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    key = F.concat_ws("/", "split", "scenario")
    now = m.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    stored = now.where(~F.col("key").endswith("/odd")).withColumn("n", F.col("n") + F.col("key").endswith("/noise").cast("int"))
    stored = stored.unionByName(spark.createDataFrame([("gone/clean", 4)], "key string, n long"))
    return manifest.summary_diff(stored, now, "key", ["n"])


@query(f"""WITH {V.SCORED}, a AS (SELECT line % 3 AS stage, coalesce(scenario, 'overall') AS scenario, count(*) AS samples, sum(edit_count)::DOUBLE / sum(reference_char_count) AS cer FROM scored GROUP BY GROUPING SETS ((line % 3), (line % 3, scenario)))
SELECT stage, round(max(cer) FILTER (scenario = 'overall'), 9) AS overall_micro_cer, round(max(cer) FILTER (scenario = 'clean'), 9) AS clean_micro_cer, round(max(cer) FILTER (scenario = 'far_field'), 9) AS far_field_micro_cer,
  round(max(cer) FILTER (scenario = 'far_field') - max(cer) FILTER (scenario = 'clean'), 9) AS gap FROM a GROUP BY stage""")
def stage_flat_summary(spark, sf_dir):
    from quillstone.plans.benchmarks import scored

    s = scored(spark, sf_dir).withColumn("stage", F.col("line") % 3)
    parts = s.groupBy("stage", "scenario").agg(A.ratio(F.sum("edit_count"), F.sum("reference_char_count")).alias("micro_cer"))
    whole = s.groupBy("stage").agg(A.ratio(F.sum("edit_count"), F.sum("reference_char_count")).alias("micro_cer")).withColumn("scenario", F.lit("overall"))
    flat = A.flat_summary(parts.unionByName(whole), "stage", ["overall", "clean", "far_field"], ["micro_cer"], gap=("far_field", "clean"), of="micro_cer")
    return flat.select("stage", *[F.round(c, 9).alias(c) for c in flat.columns if c != "stage"])


@query("""SELECT sha256(string_agg(o_orderkey || chr(9) || array_to_string(ids, ',') || chr(9) || o_orderpriority || chr(10), '' ORDER BY o_orderkey)) AS prefix_sha FROM (SELECT o_orderkey, o_orderpriority, """ + _IDS + """ AS ids FROM orders ORDER BY o_orderkey LIMIT 16)""")
def prefix_records(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", F.transform(_ids(), lambda x: x.cast("string")).alias("ids"), "o_orderpriority")
    return hashing.prefix_sha(o, "o_orderkey", ["ids", "o_orderpriority"], 16)


@query(f"""WITH {V.SAMPLES}, i AS (SELECT sample_id AS pair_id, reference, CASE WHEN line % 31 = 0 THEN 'x' ELSE reference END AS chosen_text, CASE WHEN line % 37 = 0 THEN 'v0' ELSE 'v1' END AS schema_version FROM samples)
SELECT pair_id AS key, 'schema' AS code FROM i WHERE schema_version <> 'v1' UNION ALL SELECT pair_id, 'chosen_is_not_reference' FROM i WHERE chosen_text <> reference UNION ALL SELECT 'source', 'sha_changed'""")
def strip_input_problems(spark, sf_dir):
    k = F.col("line")
    rows = V.samples(spark, sf_dir).select(F.col("sample_id").alias("pair_id"), "reference", F.when(k % 31 == 0, "x").otherwise(F.col("reference")).alias("chosen_text"), F.when(k % 37 == 0, "v0").otherwise("v1").alias("schema_version"))
    return pairs.strip_input_problems(rows, "v1", "a" * 64, "b" * 64).select("key", "code")


@query(f"""WITH {V.SAMPLES}, a AS (SELECT sample_id AS pair_id, CASE line % 9 WHEN 0 THEN NULL WHEN 1 THEN 'maybe' WHEN 2 THEN 'drop' ELSE 'keep' END AS disposition, CASE WHEN line % 8 = 0 THEN '' ELSE 'why' END AS note FROM samples)
SELECT pair_id AS key, CASE WHEN disposition IS NULL THEN 'not_reviewed' WHEN disposition = 'maybe' THEN 'bad_disposition' ELSE 'no_note' END AS code FROM a WHERE disposition IS NULL OR disposition = 'maybe' OR (disposition = 'drop' AND note = '')""")
def audit_problems(spark, sf_dir):
    k = F.col("line")
    rows = V.samples(spark, sf_dir).select(F.col("sample_id").alias("pair_id"), F.when(k % 9 == 1, "maybe").when(k % 9 == 2, "drop").when(k % 9 != 0, "keep").alias("disposition"), F.when(k % 8 == 0, "").otherwise("why").alias("note"))
    return pairs.audit_problems(rows).select("key", "code")


_FILES = """a AS (SELECT o_orderkey % 50 AS step, 'f' || o_orderkey AS name, o_custkey::VARCHAR AS sha FROM orders WHERE o_orderkey % 50 < 45 OR o_orderkey % 11 <> 0),
b AS (SELECT o_orderkey % 50 AS step, 'f' || o_orderkey AS name, CASE WHEN o_orderkey % 50 = 7 AND o_custkey % 5 = 0 THEN 'x' ELSE o_custkey::VARCHAR END AS sha FROM orders WHERE o_orderkey % 50 <> 49 OR o_custkey % 3 = 0),
p AS (SELECT coalesce(a.step, b.step) AS step, coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'extra' WHEN a.sha <> b.sha THEN 'changed' END AS problem FROM a FULL JOIN b ON a.step = b.step AND a.name = b.name)"""


def _files(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (k % 50).alias("step"), F.concat(F.lit("f"), k).alias("name"), c.cast("string").alias("sha256"))
    recorded = o.where((F.col("step") < 45) | (k % 11 != 0))
    found = o.where((F.col("step") != 49) | (c % 3 == 0)).withColumn("sha256", F.when((F.col("step") == 7) & (c % 5 == 0), "x").otherwise(F.col("sha256")))
    return recorded, found


@query(f"WITH {_FILES} SELECT step, name, problem FROM p WHERE problem IS NOT NULL")
def checkpoint_files(spark, sf_dir):
    return gates.checkpoint_problems(*_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT max(step) AS step FROM a WHERE step NOT IN (SELECT step FROM p WHERE problem IS NOT NULL)")
def checkpoint_pointer(spark, sf_dir):
    recorded, found = _files(spark, sf_dir)
    return gates.latest_complete(recorded, gates.checkpoint_problems(recorded, found))


@query(f"""WITH {V.SAMPLES} SELECT sample_id, problem FROM (SELECT sample_id, CASE WHEN line % 19 = 0 THEN 'absent' WHEN scenario = 'dropout' AND coalesce(trim(error), '') = '' THEN 'no_error' WHEN scenario <> 'dropout' AND coalesce(trim(error), '') <> '' THEN 'failed'
  WHEN scenario <> 'dropout' AND trim(prediction) = '' THEN 'empty_transcript' END AS problem FROM samples) WHERE problem IS NOT NULL""")
def smoke_predictions(spark, sf_dir):
    s = V.samples(spark, sf_dir)
    return gates.smoke_problems(s.select("sample_id", (F.col("scenario") == "dropout").alias("fails")), s.where("line % 19 <> 0").withColumn("prediction_raw", F.col("prediction")))


@query("""WITH b AS (SELECT (['clean', 'dropout', 'far_field', 'noise', 'noise', 'other'])[o_orderkey % 6 + 1] AS scenario, o_orderkey % 6 AS k, count(*) AS samples FROM orders GROUP BY 1, 2)
SELECT scenario AS key, 'scenario' AS code FROM b WHERE scenario = 'other' UNION ALL SELECT scenario, 'samples' FROM b WHERE samples < 1 UNION ALL SELECT scenario, 'micro_cer' FROM b WHERE k IN (1, 2) UNION ALL SELECT scenario, 'digest' FROM b WHERE k = 3
UNION ALL SELECT scenario, 'split' FROM b WHERE k = 4 UNION ALL SELECT 'noise', 'twice' UNION ALL SELECT 'reverb', 'absent'""")
def pinned_baseline(spark, sf_dir):
    k = F.col("k")
    name = F.element_at(F.array(*[F.lit(s) for s in ("clean", "dropout", "far_field", "noise", "noise", "other")]), (k + 1).cast("int"))
    b = V.table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 6).alias("k")).agg(F.count("*").alias("samples"))
    b = b.withColumns({
        "scenario": name, "split": F.when(k == 4, "test").otherwise("val"), "parent": F.lit("base"), "micro_cer": F.when(k == 1, float("nan")).when(k == 2, -0.1).otherwise(0.05),
        "manifest_sha256": F.when(k == 3, "abc").otherwise(F.sha2(k.cast("string"), 256)),
    })
    return gates.baseline_problems(b, "val", "base")
