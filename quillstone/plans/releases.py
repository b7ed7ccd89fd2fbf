"""Release logs, snapshot pins and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import releases
from quillstone.plans import views as V
from quillstone.sources import pins

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


_LOG = """SELECT 'u' || (user_id % 997) AS release, ts AS logged_at, event_id AS id,
  CASE event_type WHEN 'signup' THEN 'stage' WHEN 'purchase' THEN 'publish' WHEN 'view' THEN CASE WHEN event_id % 10 = 0 THEN 'retire' ELSE 'readback' END ELSE 'readback' END AS event,
  CASE WHEN event_id % 9 = 0 THEN 'other' ELSE 'payload' || (user_id % 997) END AS payload_sha, event_type <> 'error' AS matched,
  CASE WHEN event_id % 4 = 0 THEN 9 ELSE 10 END AS compared, 10 AS saved_rows FROM events"""


def release_log(spark, sf_dir):
    """Events as a log of releases: staged by signups, read back by clicks and views, published by purchases."""
    V.table(spark, sf_dir, "events").createOrReplaceTempView("quillstone_log_events")
    return spark.sql(_LOG.replace("FROM events", "FROM quillstone_log_events"))


_JUDGED = f"""WITH log AS ({_LOG}),
staged AS (SELECT release, min({{'t': logged_at, 'i': id}}) AS s, arg_min(payload_sha, {{'t': logged_at, 'i': id}}) AS sha FROM log WHERE event = 'stage' GROUP BY 1),
l1 AS (SELECT log.*, {{'t': logged_at, 'i': id}} AS p, s, sha FROM log LEFT JOIN staged USING (release)),
verified AS (SELECT release, min(p) AS v FROM l1 WHERE event = 'readback' AND p > s AND matched AND compared = saved_rows AND payload_sha = sha GROUP BY 1),
l2 AS (SELECT * FROM l1 LEFT JOIN verified USING (release)),
published AS (SELECT release, min(p) AS d FROM l2 WHERE event = 'publish' AND p > v AND payload_sha = sha GROUP BY 1),
j AS (SELECT release, id, event, CASE WHEN event NOT IN ('stage', 'readback', 'publish') THEN 'unknown_event'
    WHEN event = 'stage' THEN CASE WHEN p <> s THEN 'already_exists' END
    WHEN s IS NULL OR p < s THEN 'not_staged' WHEN d IS NOT NULL AND p > d THEN 'already_published'
    WHEN event = 'readback' AND NOT (matched AND compared = saved_rows) THEN 'partial_readback'
    WHEN event = 'publish' AND (v IS NULL OR p < v) THEN 'not_verified' WHEN payload_sha <> sha THEN 'payload_changed' END AS reason,
  CASE WHEN p >= d THEN 'published' WHEN p >= v THEN 'verified' WHEN p >= s THEN 'staged' ELSE 'none' END AS status
  FROM l2 LEFT JOIN published USING (release))"""


@query(f"{_JUDGED} SELECT id, event, reason, status FROM j")
def release_events(spark, sf_dir):
    return releases.judged_events(release_log(spark, sf_dir)).select("id", "event", "reason", "status")


@query(f"{_JUDGED} SELECT release, CASE max(CASE status WHEN 'published' THEN 3 WHEN 'verified' THEN 2 WHEN 'staged' THEN 1 ELSE 0 END) WHEN 3 THEN 'published' WHEN 2 THEN 'verified' WHEN 1 THEN 'staged' ELSE 'none' END AS status, count(reason) AS refused FROM j GROUP BY release")
def release_states(spark, sf_dir):
    return releases.current(release_log(spark, sf_dir))


@query("""WITH b AS (SELECT doc_id, sha256(coalesce(text, '')) AS a FROM documents WHERE doc_id % 11 <> 3), f AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS b FROM documents WHERE doc_id % 13 <> 5),
e AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'pin' ELSE sha256(coalesce(text, '')) END AS e FROM documents WHERE doc_id % 2 = 0)
SELECT lang || '/' || doc_id AS file, CASE WHEN a IS NULL AND b IS NULL THEN 'missing' WHEN e IS NOT NULL AND a IS DISTINCT FROM e THEN 'not_as_expected' WHEN b IS NULL THEN 'gone_during_build' WHEN a IS NULL THEN 'added_during_build' WHEN a <> b THEN 'changed_during_build' END AS problem
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN e USING (doc_id) WHERE CASE WHEN a IS NULL AND b IS NULL THEN e IS NOT NULL WHEN e IS NOT NULL AND a IS DISTINCT FROM e THEN true ELSE a IS DISTINCT FROM b END""")
def pin_changes(spark, sf_dir):
    """Two snapshots of the documents, between which some changed, against pins of every second one."""
    d = V.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    row = lambda sha: (F.col("lang").alias("label"), i.cast("string").alias("name"), sha.alias("sha256"))
    before = d.where(i % 11 != 3).select(*row(F.sha2(text, 256)))
    after = d.where(i % 13 != 5).select(*row(F.sha2(F.concat(text, F.when(i % 7 == 0, "!").otherwise("")), 256)))
    expected = d.where(i % 2 == 0).select(*row(F.when(i % 17 == 0, "pin").otherwise(F.sha2(text, 256))))
    return pins.changes(before, after, expected).select(F.concat("label", F.lit("/"), "name").alias("file"), "problem")
