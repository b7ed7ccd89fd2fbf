"""Relations derived from the test tables, the same in Spark and in SQL.

The tables hold no audio, predictions or log-probs, so the queries run the operators on these:
rows, texts and numbers that follow from the tables by fixed rules, whole texts of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENARIOS = ("clean", "dropout", "far_field", "noise", "reverb")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What Latin letters become, A to Z and a to z alike, so that a document reads as a Chinese transcript.
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HAN = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余" * 2


def han(text):
    """The whole text with Chinese characters for its Latin letters."""
    return F.translate(text, LATIN, HAN)


def digits(text):
    """The whole text with 7 for its Latin letters."""
    return F.translate(text, LATIN, "7" * len(LATIN))


def blanked(text):
    """As many blanks as the text has characters."""
    return F.repeat(F.lit(" "), F.length(text))


def beside(docs: DataFrame, made) -> DataFrame:
    """Rows (doc_id, made, text): each document's text, and beside it what `made` makes of it."""
    forms = F.array(F.struct(F.lit(False).alias("made"), F.col("text").alias("text")), F.struct(F.lit(True).alias("made"), made.alias("text")))
    return docs.select("doc_id", F.explode(forms).alias("_f")).select("doc_id", "_f.made", "_f.text")


#: The same in SQL.
HAN_SQL = f"translate({{}}, '{LATIN}', '{HAN}')".format
DIGITS_SQL = "regexp_replace({}, '[A-Za-z]', '7', 'g')".format
BLANKED_SQL = "regexp_replace({}, '.', ' ', 'gs')".format
#: Unicode white space inside a character class.
SPACE_SQL = "\\t-\\r\\x{85}\\p{Z}"
BLANK_SQL = f"(regexp_replace(coalesce({{}}, ''), '[{SPACE_SQL.replace('{', '{{').replace('}', '}}')}]', '', 'g') = '')".format


def _pick(i, names):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in five scenarios with a prediction that an item's number and scenario disturb.

    Items are short enough for edit distances over whole texts; all letters are made ASCII, in
    which bytes and code points are the same.
    """
    b = table(spark, sf_dir, "benchmark").withColumn("reference", F.regexp_replace("text", r"[^\x00-\x7F]", "q"))
    rows = b.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("k", F.col("item_id") * 5 + F.col("s"))
    ref = F.col("reference")
    prediction = (
        F.when(F.col("k") % 7 == 0, ref).when(F.col("k") % 7 == 1, F.replace(ref, F.lit("the"), F.lit("teh")))
        .when(F.col("k") % 7 == 2, F.substring(ref, 11, 100000)).when(F.col("k") % 7 == 3, F.concat(ref, F.lit(" "), ref))
        .when(F.col("k") % 7 == 4, F.lit("")).when(F.col("k") % 7 == 5, F.translate(ref, "eo", "ai")).otherwise(F.concat(F.lit("abababab"), ref))
    )
    return rows.select(
        F.concat(F.col("item_id").cast("string"), F.lit("__"), _pick(F.col("s"), SCENARIOS)).alias("sample_id"),
        F.col("item_id").cast("string").alias("source_id"), _pick(F.col("s"), SCENARIOS).alias("scenario"), F.col("k").alias("line"),
        F.when(F.col("item_id") % 10 < 8, "train").when(F.col("item_id") % 10 == 8, "val").otherwise("test").alias("split"),
        "reference", prediction.alias("prediction"),
        F.when(F.col("k") % 31 == 30, "decode failed").otherwise(F.lit(None).cast("string")).alias("error"),
        F.when(F.col("k") % 11 == 10, "length").otherwise("eos").alias("stop_reason"),
    )


SAMPLES = """samples AS (
  SELECT item_id::VARCHAR || '__' || sc AS sample_id, item_id::VARCHAR AS source_id, sc AS scenario, k AS line,
    CASE WHEN item_id % 10 < 8 THEN 'train' WHEN item_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, reference,
    CASE k % 7 WHEN 0 THEN reference WHEN 1 THEN replace(reference, 'the', 'teh') WHEN 2 THEN substr(reference, 11)
      WHEN 3 THEN reference || ' ' || reference WHEN 4 THEN '' WHEN 5 THEN translate(reference, 'eo', 'ai') ELSE 'abababab' || reference END AS prediction,
    CASE WHEN k % 31 = 30 THEN 'decode failed' END AS error, CASE WHEN k % 11 = 10 THEN 'length' ELSE 'eos' END AS stop_reason
  FROM (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', 'q', 'g') AS reference, s,
          ['clean','dropout','far_field','noise','reverb'][s + 1] AS sc, item_id * 5 + s AS k
        FROM benchmark, range(5) t(s)))"""

#: The score fields, over samples. Normal form of ASCII text: lower case without P*, Z* and Cc.
SCORED = SAMPLES + """, normed AS (
  SELECT *, regexp_replace(lower(reference), '[\\p{P}\\p{Z}\\p{Cc}]', '', 'g') AS r, regexp_replace(lower(prediction), '[\\p{P}\\p{Z}\\p{Cc}]', '', 'g') AS p,
    coalesce(trim(error), '') <> '' AS failed FROM samples
), scored AS (
  SELECT *, CASE WHEN failed THEN '' ELSE p END AS judged, levenshtein(r, CASE WHEN failed THEN '' ELSE p END)::BIGINT AS edit_count, length(r)::BIGINT AS reference_char_count,
    levenshtein(r, CASE WHEN failed THEN '' ELSE p END)::DOUBLE / length(r) AS sample_cer, p = '' AS empty_output,
    len(list_filter(range(1, length(p) - 2), lambda i: p[i:i] = p[i+1:i+1] AND p[i:i] = p[i+2:i+2] AND p[i:i] = p[i+3:i+3])) > 0
      OR len(list_filter(range(2, 9), lambda b: len(list_filter(range(1, length(p) - 3 * b + 2), lambda i: p[i:i+b-1] = p[i+b:i+2*b-1] AND p[i:i+b-1] = p[i+2*b:i+3*b-1])) > 0)) > 0 AS repeated_output,
    length(r) > 0 AND length(p) > 1.5 * length(r) AS long_output, stop_reason = 'length' AS truncated, failed AS inference_error, NOT failed AND p <> '' AS valid_output
  FROM normed)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest sources: ids that repeat, some of them and some paths and texts bad.

    Texts are the documents' own, whole, in Chinese characters; a bad one has its fault beside them.
    """
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("line"), F.when(i % 53 == 0, "bad id!").otherwise(F.concat(F.lit("u"), (i % 700).cast("string"))).alias("source_id"),
        F.when(i % 29 == 0, blanked("text")).when(i % 31 == 0, F.concat(han("text"), F.lit("<asr_text>x"))).when(i % 37 == 0, F.concat(han("text"), F.lit("abc"))).when(i % 41 == 0, digits("text")).otherwise(han("text")).alias("text"),
        F.when(i % 43 == 0, "en").otherwise("zh").alias("language"), F.when(i % 47 == 0, "../x.wav").otherwise(F.concat(F.lit("wav/"), i.cast("string"), F.lit(".wav"))).alias("audio"),
        (i % 59 != 0).alias("has_audio"), (i % 61 == 0).alias("extra"), F.concat(F.lit("S"), (i % 90).cast("string")).alias("speaker_id"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("audio_sha"), (F.length("text") * 7 % 32000).cast("long").alias("duration_ms"),
    )


SOURCES = f"""sources AS (
  SELECT doc_id AS line, CASE WHEN doc_id % 53 = 0 THEN 'bad id!' ELSE 'u' || (doc_id % 700) END AS source_id,
    CASE WHEN doc_id % 29 = 0 THEN {BLANKED_SQL('text')} WHEN doc_id % 31 = 0 THEN {HAN_SQL('text')} || '<asr_text>x' WHEN doc_id % 37 = 0 THEN {HAN_SQL('text')} || 'abc' WHEN doc_id % 41 = 0 THEN {DIGITS_SQL('text')} ELSE {HAN_SQL('text')} END AS text,
    CASE WHEN doc_id % 43 = 0 THEN 'en' ELSE 'zh' END AS language, CASE WHEN doc_id % 47 = 0 THEN '../x.wav' ELSE 'wav/' || doc_id || '.wav' END AS audio,
    doc_id % 59 <> 0 AS has_audio, doc_id % 61 = 0 AS extra, 'S' || (doc_id % 90) AS speaker_id,
    sha256(coalesce(text, '')) AS audio_sha, (length(text) * 7 % 32000)::BIGINT AS duration_ms FROM documents)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as speech intervals: a meeting is eight users, times in seconds of the day."""
    e = table(spark, sf_dir, "events")
    at = F.expr("timestampdiff(MICROSECOND, cast(to_date(ts) as timestamp_ntz), ts)") / 1e6
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("m"), (F.col("user_id") % 40).cast("string")).alias("meeting"), F.concat(F.lit("SPK"), (F.col("user_id") % 7).cast("string")).alias("speaker"),
        at.alias("xmin"), (at + F.col("event_id") % 23).alias("xmax"), F.col("event_type").alias("text"), (F.col("event_id") % 9 != 0).alias("passed"),
    )


INTERVALS = """intervals AS (
  SELECT event_id AS id, 'm' || (user_id % 40) AS meeting, 'SPK' || (user_id % 7) AS speaker, (epoch_us(ts) % 86400000000) / 1e6 AS xmin,
    (epoch_us(ts) % 86400000000) / 1e6 + event_id % 23 AS xmax, event_type AS text, event_id % 9 <> 0 AS passed FROM events)"""


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as preference pairs with log-probs; customers are groups of candidates."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("pair_id"), F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("group_id"), ((k * 7919) % 1000 / -100.0).alias("chosen_logp"), ((k * 104729) % 1000 / -100.0).alias("rejected_logp"),
        ((k * 1299709) % 1000 / -100.0).alias("ref_chosen_logp"), ((k * 15485863) % 1000 / -100.0).alias("ref_rejected_logp"), ((k * 31) % 7 - 3).cast("long").alias("char_length_delta"),
        ((k * 17) % 5 / 4.0).alias("reward"), F.when(k % 97 == 0, "boom").otherwise(F.lit(None).cast("string")).alias("error"), F.when(k % 13 == 0, "length").otherwise("eos").alias("stop_reason"),
        (k % 6).alias("candidate_index"), F.array((k % 10) / -10.0, (k % 7) / -7.0).alias("policy_logp"), F.array((k % 9) / -9.0, (k % 5) / -5.0).alias("reference_logp"),
    )


PREFERENCES = """preferences AS (
  SELECT o_orderkey AS pair_id, 'g' || o_custkey AS group_id, ((o_orderkey * 7919) % 1000) / -100.0::DOUBLE AS chosen_logp, ((o_orderkey * 104729) % 1000) / -100.0::DOUBLE AS rejected_logp,
    ((o_orderkey * 1299709) % 1000) / -100.0::DOUBLE AS ref_chosen_logp, ((o_orderkey * 15485863) % 1000) / -100.0::DOUBLE AS ref_rejected_logp, ((o_orderkey * 31) % 7 - 3)::BIGINT AS char_length_delta,
    ((o_orderkey * 17) % 5) / 4.0::DOUBLE AS reward, CASE WHEN o_orderkey % 97 = 0 THEN 'boom' END AS error, CASE WHEN o_orderkey % 13 = 0 THEN 'length' ELSE 'eos' END AS stop_reason,
    (o_orderkey % 6) AS candidate_index, [(o_orderkey % 10) / -10.0::DOUBLE, (o_orderkey % 7) / -7.0::DOUBLE] AS policy_logp, [(o_orderkey % 9) / -9.0::DOUBLE, (o_orderkey % 5) / -5.0::DOUBLE] AS reference_logp FROM orders)"""
