"""Streams that keep state: a run's visits with their windows and counters, and windows of late events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quillstone.shared import scratch

#: Parts of the runs whose states are kept together, fixed for the life of a checkpoint.
SHARDS = 128
#: One entry a run in each; `last` in microseconds.
STATE = "run array<string>, seen array<long>, invalid array<long>, consecutive array<long>, entered array<long>, last array<long>, last_id array<long>"
VISIT = "run string, id long, visit long, consecutive long, window_id long, place long, flush boolean, invalid_rate double, late boolean"


def replay(rows: DataFrame, time: str, run: str, path: str, chunks: int = 4) -> None:
    """Append `rows` to the log at `path` in `chunks` steps of rising time, as a job that logs would.

    A run's rows of one step lie in one file, so files in order of their age give each run's rows in order.
    """
    inner = [k / chunks for k in range(1, chunks)]
    borders = rows.agg(F.percentile_approx(time, inner).alias("b")).first()["b"] or []
    low = None
    for high in [*borders, None]:
        part = rows if low is None else rows.where(F.col(time) > F.lit(low))
        part = part if high is None else part.where(F.col(time) <= F.lit(high))
        part.repartition(run).sortWithinPartitions(run, time).write.mode("append").parquet(path)
        low = high if high is not None else low


def tail(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 8) -> DataFrame:
    """The rows of a log's files, oldest files first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def visit_states(visits: DataFrame, k: int, signal_only: bool = False, check_at: int = 100) -> DataFrame:
    """Rows of VISIT for a stream `visits(run string, id long, at timestamp_ntz, kind)` of kinds signal, zero and invalid.

    Each run has a state through all batches: how many visits it had, how many in a row had no
    signal (a signal sets this to 0, an invalid visit leaves it), and which window of `k` groups is being filled.
    Invalid visits never enter a window, those without signal only if not `signal_only`; `flush` marks the visit
    that fills a window, and a window never filled has none. At visit `check_at` the invalid share is given.
    Rows are taken by (at, id) within a batch; a row that sorts before one already taken is given as late and
    changes nothing, so a batch that comes again doesn't count twice. The states of a shard's runs, which
    their names' hashes deal out, are one Spark state of parallel arrays, so its rows are counted together.
    """
    counts = ["seen", "invalid", "consecutive", "entered"]

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["run", "at", "id"], kind="stable", ignore_index=True)
        held = state.get if state.exists else ([],) * 7
        old = pd.DataFrame({c: list(v) for c, v in zip(["run", *counts, "last", "last_id"], held)}).astype({c: "int64" for c in [*counts, "last", "last_id"]})
        code, runs = pd.factorize(rows["run"], use_na_sentinel=False)
        place = pd.Index(old["run"]).get_indexer(runs)
        known = place >= 0
        before = {c: np.where(known, old[c].to_numpy()[place] if len(old) else 0, 0) for c in [*counts, "last", "last_id"]}
        at, ids, kind = rows["at"].to_numpy("datetime64[us]").astype("int64"), rows["id"].to_numpy("int64"), rows["kind"].to_numpy()
        mine = {c: v[code] for c, v in before.items()}
        again = np.zeros(len(rows), bool)
        again[1:] = (code[1:] == code[:-1]) & (at[1:] == at[:-1]) & (ids[1:] == ids[:-1])
        late = again | known[code] & ((at < mine["last"]) | (at == mine["last"]) & (ids <= mine["last_id"]))
        new = ~late
        first = np.r_[True, code[1:] != code[:-1]]
        start = np.flatnonzero(first)[code]

        def so_far(flag):
            """How many rows of the run have `flag`, up to each row."""
            total = np.cumsum(flag)
            return total - (total[start] - flag[start])

        invalid, signal = new & (kind == "invalid"), new & (kind == "signal")
        enters = signal if signal_only else new & ~invalid
        seen, bad, entered = mine["seen"] + so_far(new), mine["invalid"] + so_far(invalid), mine["entered"] + so_far(enters)
        zeros = so_far(new & ~invalid & ~signal)
        # zeros of the run up to its last signal; before its first one the zeros of earlier batches count, too
        at_signal = np.maximum.accumulate(np.where(signal, np.arange(len(rows)), -1))
        since = at_signal >= start
        consecutive = np.where(since, zeros - zeros[at_signal], mine["consecutive"] + zeros)
        nth = entered - 1
        flag = lambda v, keep: pd.Series(v, dtype="Int64").where(keep)
        yield pd.DataFrame({
            "run": rows["run"], "id": ids, "visit": flag(seen, new), "consecutive": flag(consecutive, new), "window_id": flag(nth // k, enters), "place": flag(nth % k + 1, enters),
            "flush": enters & (nth % k + 1 == k), "invalid_rate": np.where(new & (seen == check_at), bad / np.maximum(seen, 1), None), "late": late,
        }).astype({"invalid_rate": "float64"})
        end = np.r_[np.flatnonzero(first)[1:] - 1, len(rows) - 1]
        # a run's last row that is not late, else its state before
        top = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))[end]
        some = top >= np.flatnonzero(first)
        now = {c: v[end] for c, v in zip(counts, (seen, bad, consecutive, entered))} | {"last": np.where(some, at[top], before["last"]), "last_id": np.where(some, ids[top], before["last_id"])}
        kept = old[~np.isin(np.arange(len(old)), place)]
        whole = pd.concat([kept, pd.DataFrame({"run": runs, **now})], ignore_index=True)
        state.update(tuple(whole[c].tolist() for c in ["run", *counts, "last", "last_id"]))

    shards = visits.withColumn("_shard", F.pmod(F.xxhash64("run"), F.lit(SHARDS)).cast("int"))
    return shards.groupBy("_shard").applyInPandasWithState(each, VISIT, STATE, "append", GroupStateTimeout.NoTimeout)


def visit_table(visits: DataFrame, k: int, signal_only: bool = False, check_at: int = 100) -> DataFrame:
    """What `visit_states` gives for a whole table, by windows over each run."""
    so_far = Window.partitionBy("run").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    enters = F.col("kind") == "signal" if signal_only else F.col("kind") != "invalid"
    count = lambda c: F.sum(c.cast("long")).over(so_far)
    rows = visits.withColumns({"visit": F.count("*").over(so_far), "_n": count(enters), "_i": count(F.col("kind") == "signal"), "_bad": count(F.col("kind") == "invalid")})
    island = Window.partitionBy("run", "_i").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(enters, (F.col("_n") - 1) % k + 1)
    return rows.select(
        "run", "id", "visit", F.sum((F.col("kind") == "zero").cast("long")).over(island).alias("consecutive"),
        F.when(enters, F.floor((F.col("_n") - 1) / k)).alias("window_id"), place.alias("place"), F.coalesce(place == k, F.lit(False)).alias("flush"),
        F.when(F.col("visit") == check_at, F.col("_bad") / F.col("visit")).alias("invalid_rate"), F.lit(False).alias("late"),
    )


def to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run `stream` over all there is into batch folders under `path`, and stop.

    A batch's rows stand in a folder of its number, which a batch that is run again replaces; with
    the same checkpoint a later call goes on where the last one, or one that broke off, ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state that batches under `path` gave each key: rows of an update stream as a table."""
    rows = spark.read.option("basePath", path).parquet(path)
    last = rows.groupBy(*keys).agg(F.max(F.struct(F.col("batch"), F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]).alias("v"))).alias("m"))
    return last.select(*keys, "m.v.*")


def late_windows(events: DataFrame, time: str, length: str, keys: Sequence[str], aggs: Sequence[Column], late: str) -> DataFrame:
    """A stream's tumbling windows; rows of windows that the watermark (`late` behind the latest time seen) has passed are not counted.

    In update mode a window's row comes again as it changes, in append mode once, when the
    watermark has passed its end.
    """
    rows = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *keys).agg(*aggs)
    names = [c for c in rows.columns if c not in ("w", *keys)]
    return rows.select(*keys, F.col("w.start").alias("window_start"), *names)


def replayed(rows: DataFrame, time: str, run: str, name: str, chunks: int = 4) -> tuple[DataFrame, str, str]:
    """A stream of `rows` from a log written in steps, with a new output path and checkpoint."""
    spark = rows.sparkSession
    log = scratch(spark, f"{name}-log")
    replay(rows, time, run, log, chunks)
    return tail(spark, log, rows.schema), scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")
