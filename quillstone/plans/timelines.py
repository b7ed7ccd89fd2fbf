"""Interval, selection-from-meetings, resume and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.hashing import keyed
from quillstone.operators import joins, windows
from quillstone.plans import views as V
from quillstone.streaming import logs, states

CATALOGUE: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH {V.INTERVALS} SELECT DISTINCT a.id FROM intervals a JOIN intervals b ON a.meeting = b.meeting AND a.speaker <> b.speaker AND least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) > 0.5""")
def interval_overlap_semi(spark, sf_dir):
    return joins.interval_overlaps(V.intervals(spark, sf_dir), "meeting", "speaker", 0.5)


@query(f"""WITH {V.INTERVALS}, n AS (SELECT * FROM intervals WHERE id % 2 = 0), f AS (SELECT id, meeting, text, CASE WHEN id % 3 = 0 THEN NULL ELSE speaker END AS speaker, xmin, xmax FROM intervals WHERE id % 2 = 1),
m AS (SELECT n.id, count(*) FILTER (f.speaker = n.speaker) AS ex, count(*) AS an, min(f.id) FILTER (f.speaker = n.speaker) AS exid, min(f.id) AS anid FROM n JOIN f ON n.meeting = f.meeting AND n.text = f.text
  AND (f.speaker IS NULL OR f.speaker = n.speaker) AND abs(n.xmin - f.xmin) <= 60 AND abs((n.xmax - n.xmin) - (f.xmax - f.xmin)) <= 5 GROUP BY n.id),
o AS (SELECT n.id, CASE WHEN ex > 0 THEN ex ELSE coalesce(an, 0) END AS matches, CASE WHEN ex > 0 THEN exid ELSE anid END AS fid FROM n LEFT JOIN m USING (id))
SELECT id, matches, CASE WHEN matches = 1 THEN fid END AS far_id, CASE WHEN matches <> 1 THEN 'unpaired_far_interval' END AS reason FROM o""")
def band_match_unique(spark, sf_dir):
    i = V.intervals(spark, sf_dir)
    far = i.where("id % 2 = 1").withColumn("speaker", F.when(F.col("id") % 3 != 0, F.col("speaker")))
    return joins.band_match(i.where("id % 2 = 0"), far, ["meeting", "text"], 60.0, 5.0).select("id", "matches", "far_id", "reason")


@query(f"""WITH {V.INTERVALS}, k AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY sha256('42:' || id || ':ood'), id) AS turn FROM intervals WHERE passed),
p AS (SELECT id, meeting, row_number() OVER (ORDER BY turn, meeting) AS position FROM k) SELECT id, meeting, position FROM p WHERE position <= 130""")
def stratified_round_robin(spark, sf_dir):
    taken, _ = windows.stratified_round_robin(V.intervals(spark, sf_dir), "meeting", keyed(42, F.col("id").cast("string"), "ood"), "id", 130)
    return taken.select("id", "meeting", "position")


# a stratum's visit in round t + 1 looks at the rows behind its t-th passing one; it comes if fewer than 130 were taken before it and round t took one
@query(f"""WITH {V.INTERVALS}, s AS (SELECT id, meeting, passed, sum(passed::INT) OVER (PARTITION BY meeting ORDER BY sha256('42:' || id || ':ood'), id) AS turn FROM intervals),
p AS (SELECT meeting, turn, row_number() OVER (ORDER BY turn, meeting) AS position FROM s WHERE passed), l AS (SELECT s.id, s.meeting, s.turn, count(p.position) AS ahead FROM s LEFT JOIN p ON p.turn <= s.turn OR (p.turn = s.turn + 1 AND p.meeting < s.meeting)
  WHERE NOT s.passed GROUP BY ALL)
SELECT id, meeting FROM l WHERE ahead < 130 AND turn <= (SELECT coalesce(max(turn), 0) FROM p WHERE position <= 130)""")
def stratified_round_robin_rejects(spark, sf_dir):
    _, lost = windows.stratified_round_robin(V.intervals(spark, sf_dir), "meeting", keyed(42, F.col("id").cast("string"), "ood"), "id", 130)
    return lost.select("id", "meeting")


_RESUME = f"WITH {V.SAMPLES}, o AS (SELECT sample_id, row_number() OVER (ORDER BY line) AS n FROM samples), d AS (SELECT sample_id, n FROM o WHERE n <= 77)"


@query(_RESUME + " SELECT sample_id FROM o WHERE n > 77")
def prefix_resume(spark, sf_dir):
    rows = windows.global_index(V.samples(spark, sf_dir).select("sample_id", "line"), ["line"], "_line").select("sample_id", "_line")
    return logs.remaining(rows, rows.where("_line <= 77"), "sample_id").select("sample_id")


_VISITS = """visits AS (SELECT 'r' || user_id AS run, event_id AS id, ts,
  CASE event_type WHEN 'error' THEN 'invalid' WHEN 'view' THEN 'zero' ELSE 'signal' END AS kind FROM events),
n AS (SELECT *, count(*) OVER w AS visit, count(*) FILTER (kind {enters}) OVER w AS e, count(*) FILTER (kind = 'signal') OVER w AS i, count(*) FILTER (kind = 'invalid') OVER w AS bad
  FROM visits WINDOW w AS (PARTITION BY run ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
SELECT run, id, visit, (count(*) FILTER (kind = 'zero') OVER (PARTITION BY run, i ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) AS consecutive,
  CASE WHEN kind {enters} THEN (e - 1) // 4 END AS window_id, CASE WHEN kind {enters} THEN (e - 1) % 4 + 1 END AS place,
  kind {enters} AND (e - 1) % 4 = 3 AS flush, CASE WHEN visit = 20 THEN bad::DOUBLE / visit END AS invalid_rate, false AS late FROM n"""


def visits(spark, sf_dir):
    """Events as visits of their user's run."""
    kind = F.when(F.col("event_type") == "error", "invalid").when(F.col("event_type") == "view", "zero").otherwise("signal")
    e = V.table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("at"), kind.alias("kind"))


def _streamed_visits(spark, sf_dir, signal_only):
    stream, out, state = states.replayed(visits(spark, sf_dir), "at", "run", "visits")
    states.to_end(states.visit_states(stream, 4, signal_only, 20), out, state)
    return spark.read.parquet(out).drop("batch")


@query(f"WITH {_VISITS.format(enters="<> 'invalid'")}")
def stream_visit_windows(spark, sf_dir):
    """Count windows and counters of every run, by a stream over the log of its visits."""
    return _streamed_visits(spark, sf_dir, False)


@query(f"WITH {_VISITS.format(enters="= 'signal'")}")
def stream_signal_windows(spark, sf_dir):
    """The same, where only groups with a signal fill windows."""
    return _streamed_visits(spark, sf_dir, True)


@query(f"WITH {_VISITS.format(enters="<> 'invalid'")}")
def visit_windows(spark, sf_dir):
    return states.visit_table(visits(spark, sf_dir), 4, False, 20)


@query("""SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS n, count(DISTINCT event_id) AS ids, max(value) AS high FROM events GROUP BY 1, 2""")
def stream_log_windows(spark, sf_dir):
    """Windows by a stream over the log of events, kept by key from its batches' updates."""
    e = V.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    stream, out, state = states.replayed(e, "ts", "event_type", "events")
    aggs = [F.count("*").alias("n"), F.count("event_id").alias("ids"), F.max("value").alias("high")]
    states.to_end(states.late_windows(stream, "ts", "15 minutes", ["event_type"], aggs, "10 minutes"), out, state, "update")
    return states.latest(spark, out, ["event_type", "window_start"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_event_windows(spark, sf_dir):
    """The batch form of `logs.windowed`, which a stream of the same rows must reach."""
    e = V.table(spark, sf_dir, "events")
    out = logs.windowed(e, "ts", "1 hour", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("window.start").alias("window_start"), "n", F.round("total", 4).alias("total"))
