import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstone.operators import joins, windows
from quillstone.shared import scratch
from quillstone.streaming import states

START = datetime(2024, 1, 1)
SCHEMA = "run string, id long, at timestamp_ntz, kind string"


def _visits(n=400, seed=2):
    draw = random.Random(seed)
    return [(f"r{draw.randrange(4)}", k, START + timedelta(seconds=k // 3), draw.choice(["signal", "zero", "zero", "invalid"])) for k in range(n)]


def _plain(rows, k, signal_only, check_at):
    out, runs = {}, {}
    for run, i, _, kind in sorted(rows, key=lambda r: (r[2], r[1])):
        s = runs.setdefault(run, {"seen": 0, "invalid": 0, "zero": 0, "entered": 0})
        s["seen"] += 1
        window = place = None
        if kind == "invalid":
            s["invalid"] += 1
        else:
            s["zero"] = 0 if kind == "signal" else s["zero"] + 1
            if kind == "signal" or not signal_only:
                window, place = divmod(s["entered"], k)
                place, s["entered"] = place + 1, s["entered"] + 1
        rate = s["invalid"] / s["seen"] if s["seen"] == check_at else None
        out[i] = (run, s["seen"], s["zero"], window, place, place == k, rate, False)
    return out


def _rows(df):
    return {r.id: (r.run, r.visit, r.consecutive, r.window_id, r.place, r.flush, r.invalid_rate, r.late) for r in df.collect()}


@pytest.mark.parametrize("signal_only", [False, True])
def test_visits_in_steps_equal_the_table(spark, signal_only):
    rows = _visits()
    df = spark.createDataFrame(rows, SCHEMA)
    want = _plain(rows, 3, signal_only, 20)
    assert _rows(states.visit_table(df, 3, signal_only, 20)) == want
    stream, out, state = states.replayed(df, "at", "run", "t")
    states.to_end(states.visit_states(stream, 3, signal_only, 20), out, state)
    assert _rows(spark.read.parquet(out)) == want


def test_stream_goes_on_where_it_stopped_and_marks_late_rows(spark):
    rows = _visits(120)
    log, out, state = (scratch(spark, n) for n in ("log", "out", "state"))
    df = spark.createDataFrame(rows, SCHEMA)
    first, rest = df.where("id < 50"), df.where("id >= 50")
    run = lambda: states.to_end(states.visit_states(states.tail(spark, log, df.schema), 3), out, state)
    first.write.mode("append").parquet(log)
    run()
    assert spark.read.parquet(out).count() == 50
    run()  # nothing new
    rest.write.mode("append").parquet(log)
    spark.createDataFrame([("r0", 9000, START - timedelta(days=1), "signal")], SCHEMA).write.mode("append").parquet(log)
    run()
    got = spark.read.parquet(out)
    assert got.where("late").select("id").collect()[0][0] == 9000
    assert _rows(got.where("not late")) == _plain(rows, 3, False, 100)


def test_a_batch_that_is_run_again_replaces_itself(spark):
    df = spark.createDataFrame(_visits(60), SCHEMA)
    stream, out, state = states.replayed(df, "at", "run", "again")
    counted = stream.groupBy("run").agg(F.count("*").alias("n"))

    def to(path, number):
        def write(batch, k):
            batch.write.mode("overwrite").parquet(f"{path}/batch={k}")
            if k == number:
                raise RuntimeError("lost after the write")

        return write

    query = counted.writeStream.foreachBatch(to(out, 0)).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost after the write"):
        query.awaitTermination()
    states.to_end(counted, out, state, "update")
    got = {r.run: r.n for r in states.latest(spark, out, ["run"]).collect()}
    assert got == {r.run: r["count"] for r in df.groupBy("run").count().collect()}


def test_late_events_are_left_out(spark):
    at = lambda m: START + timedelta(minutes=m)
    log, out, state = (scratch(spark, n) for n in ("log", "out", "state"))
    schema = "ts timestamp, k string"
    for part in ([(at(1), "a"), (at(2), "a"), (at(100), "a")], [(at(3), "a"), (at(95), "a")], [(at(200), "b")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(log)
        stream = states.late_windows(states.tail(spark, log, spark.read.parquet(log).schema, 1), "ts", "10 minutes", ["k"], [F.count("*").alias("n")], "20 minutes")
        states.to_end(stream, out, state, "update")
    got = {(r.k, r.window_start): r.n for r in states.latest(spark, out, ["k", "window_start"]).collect()}
    assert got == {("a", at(0)): 2, ("a", at(100)): 1, ("a", at(90)): 1, ("b", at(200)): 1}


def test_sweep_over_many_tasks_against_all_pairs(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed in range(3):
            draw = random.Random(seed)
            rows = [(i, draw.choice(["m0", "m0", "m0", "m1", None]), draw.choice(["a", "a", "a", "b", "c", None]), x := round(draw.uniform(0, 90), draw.randrange(3)), x + draw.choice([0, 0.2, 0.3, 1, 5, 40])) for i in range(160)]
            df = spark.createDataFrame(rows, "id long, g string, o string, xmin double, xmax double")
            want = {a[0] for a in rows for b in rows if None not in (a[1], a[2], b[2]) and a[1] == b[1] and a[2] != b[2] and min(a[4], b[4]) - max(a[3], b[3]) > 0.25}
            got = [r.id for r in joins.interval_overlaps(df, "g", "o", 0.25).collect()]
            assert sorted(got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sweep_of_one_large_meeting_with_a_long_interval(spark):
    # 100,000 short intervals of one speaker, some of another, and one that lasts all day
    short = spark.range(100_000).selectExpr("id", "'m' AS g", "if(id % 1000 = 7, 'b', 'a') AS o", "id * 0.8D AS xmin", "id * 0.8D + 0.5D AS xmax")
    day = spark.createDataFrame([(-1, "m", "a", 0.0, 86400.0)], short.schema)
    got = {r.id for r in joins.interval_overlaps(short.unionByName(day), "g", "o", 0.1).collect()}
    assert got == {-1, *range(7, 100_000, 1000)}


def test_count_windows_by_epoch(spark):
    df = spark.range(23).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS e")
    got = {}
    for r in windows.count_windows(df, ["id"], 3, epoch="e").collect():
        got.setdefault((r.e, r.window_id), []).append(r.id)
    for e in (None, 1, 2):
        ids = [i for i in range(23) if (i % 3 or None) == e]
        for w in range(-(-len(ids) // 3)):
            assert sorted(got.pop((e, w))) == ids[3 * w : 3 * w + 3]
    assert not got
    assert windows.count_windows(df, ["id"], 3, epoch="e", keep_tail=False).count() == 6 + 6 + 6


@pytest.mark.parametrize("signal_only", [False, True])
def test_runs_of_a_shard_share_one_state(spark, signal_only, monkeypatch):
    monkeypatch.setattr(states, "SHARDS", 3)
    draw = random.Random(5)
    rows = [(f"r{draw.randrange(40)}", i, START + timedelta(minutes=draw.randrange(30)), draw.choice(["signal", "zero", "zero", "invalid"])) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    stream, out, state = states.replayed(df, "at", "run", "shards")
    states.to_end(states.visit_states(stream, 3, signal_only, 9), out, state)
    assert _rows(spark.read.parquet(out)) == _rows(states.visit_table(df, 3, signal_only, 9))
    assert spark.read.format("statestore").load(state).count() <= 3
