"""Queries over the contracts of training inputs: names, pinned metrics, metadata, smoke subsets, leaks, two stages' clusters, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import segment, tokenizing
from quillstone.functions import sequence as S
from quillstone.functions import text as T
from quillstone.operators import aggregates as A
from quillstone.operators import contracts as C
from quillstone.plans import views as V
from quillstone.plans.benchmarks import _STAGES, rounded, scored, staged
from quillstone.plans.curation import _MANIFEST, _manifest

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


#: A parameter's name by a line item's numbers, as one expression that both engines read alike.
_NAME = """CASE l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'base_model.' WHEN 2 THEN 'base_model.audio_tower.' WHEN 3 THEN 'x' ELSE 'projector.' END || 'thinker.model.layers.'
  || CAST(l_partkey % 48 AS STRING) || '.self_attn.' || CASE l_linenumber % 5 WHEN 0 THEN 'q_proj' WHEN 1 THEN 'k_proj' WHEN 2 THEN 'v_proj' WHEN 3 THEN 'o_proj' ELSE 'gate_proj' END
  || CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '.lora_A.weight' WHEN 2 THEN '.lora_B.default.weight' WHEN 3 THEN '.lora_C.weight' ELSE '.weight' END"""
_PROJECTION = r"(^|\.)thinker\.model\.layers\.[0-9]+\.self_attn\.(q_proj|k_proj|v_proj|o_proj)"


@query(f"""SELECT name, count(*) AS n, regexp_matches(name, '{_PROJECTION}$') AND NOT regexp_matches(name, 'audio_tower|embed_tokens|lm_head|projector') AS attention,
  regexp_matches(name, '{_PROJECTION}\\.lora_[AB](\\.default)?\\.weight$') AS trainable FROM (SELECT {_NAME} AS name FROM lineitem) GROUP BY name""")
def trainable_names(spark, sf_dir):
    names = V.table(spark, sf_dir, "lineitem").select(F.expr(_NAME).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return names.select("name", "n", C.decoder_attention(F.col("name")).alias("attention"), C.trainable(F.col("name")).alias("trainable"))


@query(f"""SELECT name, 'outside' AS problem, count(*) AS n FROM (SELECT {_NAME} AS name FROM lineitem) WHERE NOT regexp_matches(name, '{_PROJECTION}\\.lora_[AB](\\.default)?\\.weight$') GROUP BY name""")
def trainable_problems(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select(F.expr(_NAME).alias("name"))
    return C.trainable_problems(rows).groupBy("name", "problem").agg(F.count("*").alias("n"))


#: Metrics documents of a customer's number k, some of them at fault.
_METRICS = """'{"schema_version":"' || CASE WHEN k % 11 = 0 THEN 'metrics-v0' ELSE 'metrics-v1' END || '","split":"' || CASE WHEN k % 13 = 0 THEN 'test' ELSE 'val' END || '","parent":"base",'
  || CASE WHEN k % 17 = 0 THEN '"note":"x",' ELSE '' END || '"samples":' || CASE WHEN k % 19 = 0 THEN '0' WHEN k % 23 = 0 THEN '"500"' ELSE '500' END
  || ',"by_scenario":{"clean":{"samples":100,"micro_cer":0.' || CAST(k % 10 AS STRING) || '},"noise":{"samples":100,"micro_cer":' || CASE WHEN k % 29 = 0 THEN '-0.5' ELSE '0.25' END
  || '},' || CASE WHEN k % 31 = 0 THEN '' ELSE '"reverb":{"samples":100,"micro_cer":0.5},' END || '"far_field":{"samples":100,"micro_cer":0.5},"dropout":{"samples":100' || CASE WHEN k % 37 = 0 THEN '' ELSE ',"micro_cer":1.5' END || '}}}'"""


@query(f"""WITH d AS (SELECT k, ({_METRICS})::JSON AS doc FROM (SELECT c_custkey AS k FROM customer)),
want(s) AS (VALUES ('clean'), ('noise'), ('reverb'), ('far_field'), ('dropout')),
each AS (SELECT k, s, json_extract(doc, '$.by_scenario.' || s) AS part FROM d, want)
SELECT k AS key, 'schema_version' AS path, 'choice' AS problem FROM d WHERE (doc->>'schema_version') <> 'metrics-v1'
UNION ALL SELECT k, 'split', 'choice' FROM d WHERE (doc->>'split') <> 'val'
UNION ALL SELECT k, name, 'unknown' FROM (SELECT k, unnest(json_keys(doc)) AS name FROM d) WHERE name NOT IN ('schema_version', 'split', 'parent', 'samples', 'by_scenario')
UNION ALL SELECT k, 'samples', CASE WHEN json_type(doc->'samples') = 'VARCHAR' THEN 'kind' ELSE 'range' END FROM d WHERE json_type(doc->'samples') = 'VARCHAR' OR (doc->>'samples')::INT < 1
UNION ALL SELECT k, 'by_scenario.' || s, 'missing' FROM each WHERE part IS NULL
UNION ALL SELECT k, 'by_scenario.' || s || '.micro_cer', 'missing' FROM each WHERE part IS NOT NULL AND (part->'micro_cer') IS NULL
UNION ALL SELECT k, 'by_scenario.' || s || '.micro_cer', 'range' FROM each WHERE (part->>'micro_cer')::DOUBLE < 0""")
def metrics_problems(spark, sf_dir):
    docs = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select(F.col("k").alias("key"), F.expr(_METRICS).alias("doc"))
    return C.metrics_problems(docs, "key", "doc", C.metrics_schema("metrics-v1", "val", "base"))


#: Members of pair metadata, a configuration and a release by an order's number k.
_META = {
    "payload": {
        "schema_version": "CASE WHEN k % 2 = 0 THEN 'strip-v1' ELSE 'pairs-v1' END", "status": "CASE WHEN k % 7 = 0 THEN 'draft' ELSE 'pairs_gap_stripped' END",
        "trainable": "CASE WHEN k % 11 = 0 THEN 'true' ELSE 'false' END", "gap_strip": "CASE WHEN k % 13 = 0 THEN 'none' ELSE 'dropout' END", "seed": "CASE WHEN k % 17 = 0 THEN '7' ELSE '42' END",
        "train_pairs_sha256": "CASE WHEN k % 19 = 0 THEN 'x' ELSE 't' END", "val_pairs_sha256": "CASE WHEN k % 23 = 0 THEN NULL ELSE 'v' END", "source_train_pairs_sha256": "CASE WHEN k % 29 = 0 THEN 'x' ELSE 'st' END",
        "source_val_pairs_sha256": "CASE WHEN k % 31 = 0 THEN 'x' ELSE 'sv' END", "release_id": "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 5 = 0 THEN 'other' ELSE 'parent' END",
        "adapter_sha256": "CASE WHEN k % 37 = 0 THEN 'x' ELSE 'a' END",
    },
    "config": {
        "launch_utterance": "CASE WHEN k % 41 = 0 THEN NULL ELSE 'go' END", "seed": "'42'", "parent_release": "'parent'", "null_train_pairs_sha256": "'t'", "null_val_pairs_sha256": "'v'",
        "source_null_train_pairs_sha256": "'st'", "source_null_val_pairs_sha256": "'sv'",
    },
    "release": {"adapter_sha256": "'a'"},
}


@query(f"""WITH o AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k, {', '.join(f'{v} AS {n}' for n, v in _META['payload'].items())}, {_META['config']['launch_utterance']} AS launch FROM o)
SELECT k AS key, problem FROM (SELECT k, CASE WHEN k % 43 = 0 THEN 'no_object' WHEN schema_version = 'strip-v1' THEN CASE WHEN launch IS DISTINCT FROM 'go' THEN 'launch' WHEN status <> 'pairs_gap_stripped' THEN 'status'
  WHEN trainable <> 'false' THEN 'trainable' WHEN gap_strip <> 'dropout' THEN 'gap_strip' WHEN seed <> '42' THEN 'seed' WHEN train_pairs_sha256 <> 't' THEN 'train_pairs_sha256' WHEN val_pairs_sha256 IS DISTINCT FROM 'v' THEN 'val_pairs_sha256'
  WHEN source_train_pairs_sha256 <> 'st' THEN 'source_train_pairs_sha256' WHEN source_val_pairs_sha256 <> 'sv' THEN 'source_val_pairs_sha256' WHEN release_id <> 'parent' THEN 'release_id' END
  ELSE CASE WHEN release_id IS DISTINCT FROM 'parent' THEN 'release_id' WHEN adapter_sha256 <> 'a' THEN 'adapter_sha256' WHEN train_pairs_sha256 <> 't' THEN 'train_pairs_sha256' WHEN val_pairs_sha256 IS DISTINCT FROM 'v' THEN 'val_pairs_sha256' END
  END AS problem FROM p) WHERE problem IS NOT NULL""")
def pair_metadata_problems(spark, sf_dir):
    maps = {name: F.create_map(*[x for n, v in members.items() for x in (F.lit(n), F.expr(v))]) for name, members in _META.items()}
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    rows = rows.select(F.col("k").alias("key"), F.when(F.col("k") % 43 != 0, maps["payload"]).alias("payload"), maps["config"].alias("config"), maps["release"].alias("release"))
    return C.pair_metadata_problems(rows, "strip-v1", "go", "dropout")


@query("""WITH a AS (SELECT o_orderkey AS key, CASE o_orderkey % 9 WHEN 0 THEN 'passed' WHEN 1 THEN 'unlistened' END AS status FROM orders),
d AS (SELECT l_orderkey AS key, l_linenumber AS s, CASE WHEN bool_or(l_returnflag = 'R') THEN 'listened' ELSE 'unlistened' END AS disposition FROM lineitem GROUP BY 1, 2)
SELECT key, 'status' AS problem FROM a WHERE status = 'passed' UNION ALL SELECT key, 'no_scenarios' FROM a WHERE key NOT IN (SELECT key FROM d)
UNION ALL SELECT d.key, 'disposition_s' || s FROM d JOIN a ON a.key = d.key WHERE disposition <> 'unlistened'""")
def untouched_audits(spark, sf_dir):
    k = F.col("o_orderkey")
    audits = V.table(spark, sf_dir, "orders").select(k.alias("key"), F.when(k % 9 == 0, "passed").when(k % 9 == 1, "unlistened").alias("status"))
    each = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), "l_linenumber").agg(F.when(F.bool_or(F.col("l_returnflag") == "R"), "listened").otherwise("unlistened").alias("d"))
    # an order has a few line numbers
    parts = each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), "l_linenumber"), "d"))).alias("by_scenario"))
    return C.untouched_audit(audits.join(parts, "key", "left"))


_SMOKE = _MANIFEST + """, b AS (SELECT source_id, scenario, split FROM m UNION ALL SELECT source_id, scenario, 'val' FROM m WHERE split = 'train' AND source_id::INT % 4 = 0),
g AS (SELECT split, source_id, count(*) AS n, count(DISTINCT scenario) FILTER (scenario <> 'odd') AS kinds, count(DISTINCT scenario) AS named FROM b GROUP BY 1, 2),
r AS (SELECT split, source_id, row_number() OVER (PARTITION BY split ORDER BY sha256('42:' || source_id || ':smoke-' || split), source_id) AS position FROM g WHERE n = 5 AND kinds = 5),
c AS (SELECT * FROM r WHERE position <= CASE split WHEN 'train' THEN 60 WHEN 'val' THEN 30 ELSE 100000 END)"""


@query(_SMOKE + """ SELECT DISTINCT split AS key, 'no_source' AS problem FROM b WHERE scenario = 'odd' UNION ALL SELECT split || '/' || source_id, 'duplicate_scenario' FROM g WHERE n > named
UNION ALL SELECT 'test', 'few_sources' WHERE (SELECT count(*) FROM c WHERE split = 'test') < 100000 UNION ALL SELECT 'train', 'few_sources' WHERE (SELECT count(*) FROM c WHERE split = 'train') < 60
UNION ALL SELECT 'val', 'few_sources' WHERE (SELECT count(*) FROM c WHERE split = 'val') < 30 UNION ALL SELECT source_id, 'overlap' FROM c GROUP BY source_id HAVING count(DISTINCT split) > 1""")
def smoke_subset_problems(spark, sf_dir):
    m = _manifest(spark, sf_dir).select("source_id", "scenario", "split")
    both = m.unionByName(m.where("split = 'train' AND cast(source_id AS int) % 4 = 0").withColumn("split", F.lit("val")))
    return C.smoke_subset_problems(both, 42, {"train": ("smoke-train", 60), "val": ("smoke-val", 30), "test": ("smoke-test", 100_000)})


_PAIRED = "CASE WHEN doc_id % 50 = 0 THEN 'val' WHEN (doc_id - doc_id % 3) % 10 < 8 THEN 'train' ELSE 'val' END"


@query(f"""WITH p AS (SELECT {_PAIRED} AS split, 'u' || (doc_id - doc_id % 3) AS source_id, sha256(coalesce(text, '')) AS audio, CASE WHEN doc_id % 71 = 0 THEN 'bad_header' END AS wav_problem FROM documents)
SELECT DISTINCT audio AS key, 'audio_' || wav_problem AS problem FROM p WHERE wav_problem IS NOT NULL UNION ALL SELECT split || '/' || audio, 'duplicate_audio' FROM p GROUP BY split, audio HAVING count(*) > 1
UNION ALL SELECT source_id, 'leak_source' FROM p GROUP BY source_id HAVING count(DISTINCT split) > 1 UNION ALL SELECT audio, 'leak_audio' FROM p GROUP BY audio HAVING count(DISTINCT split) > 1""")
def pair_source_problems(spark, sf_dir):
    k = F.col("doc_id")
    rows = V.table(spark, sf_dir, "documents").select(
        F.expr(_PAIRED).alias("split"), F.concat(F.lit("u"), k - k % 3).alias("source_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("audio"), F.when(k % 71 == 0, "bad_header").alias("wav_problem"),
    )
    return C.pair_source_problems(rows)


@query(f"""WITH {V.SCORED}, x AS (SELECT DISTINCT source_id FROM samples), s(scope) AS (VALUES ('overall'), ('noise'), ('reverb'))
SELECT s.scope, x.source_id AS cluster, coalesce(sum(edit_count), 0)::BIGINT AS a, coalesce(sum(greatest(0, edit_count - line % 3)), 0)::BIGINT AS b, coalesce(sum(reference_char_count), 0)::BIGINT AS refs
FROM x CROSS JOIN s LEFT JOIN scored q ON q.source_id = x.source_id AND (s.scope = 'overall' OR q.scenario = s.scope) AND NOT (q.line % 10 = 3 AND q.scenario = 'noise') AND q.line % 10 <> 3 GROUP BY 1, 2""")
def paired_clusters(spark, sf_dir):
    rows = scored(spark, sf_dir).select("sample_id", "source_id", "scenario", "line", "edit_count", "reference_char_count")
    # the manifest has samples that this comparison leaves out; their clusters stay
    fewer = F.greatest(F.lit(0), F.col("edit_count") - F.col("line") % 3)
    manifest = rows.where("line % 10 <> 3").select("sample_id", "source_id")
    return C.paired_clusters(manifest, rows.drop("source_id"), rows.withColumn("edit_count", fewer), "edit_count", "reference_char_count", ["noise", "reverb"])


@query()
def paired_bootstrap(spark, sf_dir):
    """Interval of the later stage's change in each scope, over clusters of two joined stages."""
    return rounded(A.bootstrap_numpy(paired_clusters(spark, sf_dir), "scope", "cluster", "a", "b", "refs"))


_SETTINGS = {"noise": {"snr_db": 12.5}, "reverb": {"rt60": 0.5}, "far_field": {"metres": 3}, "dropout": {"share": 0.25}}


@query(f"""WITH {V.SAMPLES} SELECT sample_id, '{{"schema_version":"manifest-v1","sample_id":"' || sample_id || '","source_utterance_id":"' || source_id || '","audio":"wavs/' || sample_id || '.wav","text":' || to_json(reference)::VARCHAR
  || ',"language":"zh","scenario":"' || scenario || '","split":"' || split || '"' || CASE WHEN line % 3 = 0 THEN ',"speaker_id":"S' || (line % 90) || '"' ELSE '' END
  || CASE scenario WHEN 'clean' THEN '' ELSE ',"augmentation":{{"type":"' || scenario || '","processor_version":"p1",' || CASE scenario WHEN 'noise' THEN '"snr_db":12.5,"seed":' || line WHEN 'reverb' THEN '"rt60":0.5'
  WHEN 'far_field' THEN '"metres":3' ELSE '"share":0.25' END || '}}' END || '}}' AS line FROM samples""")
def manifest_lines(spark, sf_dir):
    k = F.col("line")
    rows = V.samples(spark, sf_dir).select("sample_id", "source_id", "scenario", "split", F.col("reference").alias("text"), k.alias("seed"), F.when(k % 3 == 0, F.concat(F.lit("S"), k % 90)).alias("speaker_id"))
    return C.manifest_lines(rows, "manifest-v1", _SETTINGS, "p1")


@query(f"""WITH {V.SAMPLES}, c AS (SELECT source_id, '","source_utterance_id":"' || source_id || '","audio":"wavs/' AS head, '.wav","text":' || to_json(reference)::VARCHAR || ',"language":"zh","scenario":"' AS body FROM samples WHERE scenario = 'clean'),
f(name, fails, scenario, audio, more) AS (VALUES ('clean', false, 'clean', '', ''), ('noise', false, 'noise', '_noise', ',"augmentation":{{"type":"gaussian_noise","snr_db":12.5,"seed":7,"version":"n1"}}'),
  ('missing', true, 'dropout', NULL, ',"augmentation":{{"type":"missing_file","version":"n1"}}'))
SELECT source_id || '-' || name AS sample_id, fails, '{{"schema_version":"manifest-v1","sample_id":"' || source_id || '-' || name || head || coalesce(source_id || audio, 'does_not_exist') || body || scenario || '","split":"smoke"' || more || '}}' AS line FROM c, f""")
def smoke_manifest(spark, sf_dir):
    clean = V.samples(spark, sf_dir).where("scenario = 'clean'").select("source_id", F.col("reference").alias("text"))
    return C.smoke_manifest(clean, "manifest-v1", "n1", 12.5, 7)


@query(f"""WITH {V.SCORED}, {_STAGES.replace('count(*) AS samples,', 'sum(greatest(0, edit_count - stage_no * (line % 3)))::BIGINT AS e,')},
w AS (SELECT stage, stage_no, sum(e)::BIGINT AS e, avg(micro_cer) FILTER (scenario <> 'clean') AS c FROM stages GROUP BY ALL),
p AS (SELECT *, e - first_value(e) OVER o AS db, e - coalesce(lag(e) OVER o, e) AS dp FROM w WINDOW o AS (ORDER BY stage_no)),
q AS (SELECT scenario, max(e) FILTER (stage_no = 0) AS e0, max(e) FILTER (stage_no = 1) AS e1, max(e) FILTER (stage_no = 2) AS e2, max(e) FILTER (stage_no = 3) AS e3,
  max(micro_cer) FILTER (stage_no = 0) AS c0, max(micro_cer) FILTER (stage_no = 1) AS c1, max(micro_cer) FILTER (stage_no = 2) AS c2, max(micro_cer) FILTER (stage_no = 3) AS c3 FROM stages GROUP BY scenario)
SELECT 1 AS section, (stage_no + 1)::INT AS place, printf('| `%s` | `%d` | `%+d` | `%+d` | `%.6f` |', upper(stage), e, db, dp, c) AS line FROM p
UNION ALL SELECT 2, list_position(['clean', 'noise', 'reverb', 'far_field', 'dropout'], scenario)::INT, printf('| `%s` | `%d` (`%.6f`) | `%d` (`%.6f`) | `%d` (`%.6f`) | `%d` (`%.6f`) | `%+d` | `%+d` |', scenario, e0, c0, e1, c1, e2, c2, e3, c3, e3 - e0, e3 - e2) FROM q""")
def report_lines(spark, sf_dir):
    return C.report_lines(staged(spark, sf_dir), ["base", "sft", "dpo", "rl"], T.SCENARIOS)


@query()
def segmented_wer(spark, sf_dir):
    """Word error rates by scenario of unspaced texts, cut by a dictionary that the benchmark's words make."""
    rows = scored(spark, sf_dir).select("sample_id", "scenario", "inference_error", "reference_normalized", "prediction_normalized")
    words = V.table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\x00-\x7F]", "q"), "[^a-z0-9]+")).alias("word"))
    dictionary, _ = segment.dictionary_of(words, "word", "benchmark")
    cut = segment.segmented(segment.segmented(rows, "reference_normalized", "ref", dictionary), "prediction_normalized", "pred", dictionary)
    out = cut.withColumns(S.word_scored(F.col("ref"), F.col("pred"), F.col("inference_error")))
    out = out.groupBy("scenario").agg(F.count("*").alias("samples"), F.sum("word_edit_count").alias("word_edit_count"), F.sum("reference_word_count").alias("reference_word_count"), A.ratio(F.sum("word_edit_count"), F.sum("reference_word_count")).alias("micro_wer"))
    return rounded(out)


@query()
def transcript_token_counts(spark, sf_dir):
    """Tokens of every document's whole text and an end token, by a public tokenizer."""
    import public_tokenizers

    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenizing.token_counts(docs, "text", "n_tokens", public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>").drop("text")
