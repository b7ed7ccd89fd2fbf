"""Ranking, sampling and order-dependent operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quillstone.shared import cut


def first_wins(rows: DataFrame, key: str, order: str, value: str, among: Column | None = None) -> DataFrame:
    """`rows` with won: whether the row has the value of its key's first row in `order`, of those that are `among`.

    The first value is a minimum per key, combined before the shuffle, so a key that many rows
    share is no single task's work.
    """
    first = (rows if among is None else rows.where(among)).groupBy(F.col(key).alias("_k")).agg(F.min_by(value, order).alias("_v"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("won", F.col(value).eqNullSafe(F.col("_v"))).drop("_k", "_v")


def drop_cross_split(rows: DataFrame, keys: Sequence[tuple[str, str]], order: str = "source_id", split: str = "split") -> DataFrame:
    """`rows` with reason: for each (key, reason) in turn, rows whose key was first seen in another
    split are rejected; later keys see only the rows that the earlier ones kept.

    The rows are worked out once, into the folder that driver and executors share; each key then
    adds one minimum and one join over them.
    """
    out, kept = cut(rows).withColumn("reason", F.lit(None).cast("string")), F.col("reason").isNull()
    for key, why in keys:
        out = first_wins(out, key, order, split, kept)
        out = out.withColumn("reason", F.when(kept & ~F.col("won"), why).otherwise(F.col("reason"))).drop("won")
    return out


def keep_first(rows: DataFrame, key: str, order: Sequence[str], reason: str) -> DataFrame:
    """`rows` with reason null on the first row of each key in `order` (a unique one), else `reason`."""
    lead = F.struct(*order)
    first = rows.groupBy(F.col(key).alias("_k")).agg(F.min(lead).alias("_first"))
    out = rows.join(first, F.col(key).eqNullSafe(F.col("_k")))
    return out.withColumn("reason", F.when(lead != F.col("_first"), reason)).drop("_k", "_first")


def top_k_per_group(rows: DataFrame, groups: Sequence[str], rank: Column, k: int, tie: str, dims: DataFrame | None = None, salts: int = 16) -> DataFrame:
    """The k rows of each group with the smallest rank, with position from 1.

    Rows are cut to k in `salts` parts of a group before the parts meet, so a large group costs
    no task more than its part and k * salts rows. With `dims`, absent groups appear empty.
    """
    ranked = rows.withColumn("_rank", rank).withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
    order = [F.col("_rank"), F.col(tie)]
    part = Window.partitionBy(*groups, "_salt").orderBy(*order)
    whole = Window.partitionBy(*groups).orderBy(*order)
    some = ranked.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k)
    out = some.withColumn("position", F.row_number().over(whole)).where(F.col("position") <= k).drop("_rank", "_salt", "_n")
    return out if dims is None else dims.join(out, list(groups), "left")


def top_k(rows: DataFrame, rank: Column, k: int, tie: str) -> DataFrame:
    return rows.orderBy(rank, F.col(tie)).limit(k)


def global_index(rows: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """`rows` with their place from 1 in a total order, without one task that sees all.

    Rows are dealt by range and numbered within their range; the ranges' sizes, one row each,
    give the offsets. `order` must be unique.
    """
    return running_sum(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).withColumn(name, F.col(name) + 1).drop("_one")


def running_sum(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """`rows` with the sum of `value` over all rows before, in a total order (nulls first).

    Rows are dealt by range into the folder that driver and executors share, so the ranges stay as
    they are while their totals are taken, and blocks lost with an executor are read there again.
    """
    keys = [F.col(c) for c in order]
    dealt = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_total"))
    # one row a range
    base = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part", "_base")


def count_windows(rows: DataFrame, order: Sequence[str], k: int, epoch: str | None = None, keep_tail: bool = True) -> DataFrame:
    """`rows` with window_id: each k rows in order; per epoch with a short tail, or over all epochs.

    Places are counted over all rows by range, and an epoch's begin with its first, so no task sees
    a whole epoch. Over all epochs, and within each, the tail is dropped unless kept.
    """
    out = global_index(rows, [*([epoch] if epoch is not None else []), *order], "_n")
    if epoch is None:
        out = out.withColumn("window_id", F.floor((F.col("_n") - 1) / k))
        key = ["window_id"]
    else:
        first = out.groupBy(F.col(epoch).alias("_e")).agg(F.min("_n").alias("_first"))
        out = out.join(first, F.col(epoch).eqNullSafe(F.col("_e"))).withColumn("window_id", F.floor((F.col("_n") - F.col("_first")) / k)).drop("_e", "_first")
        key = [epoch, "window_id"]
    if not keep_tail:
        whole = out.groupBy(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(key)]).agg(F.count("*").alias("_size")).where(F.col("_size") == k).drop("_size")
        same = F.lit(True)
        for i, c in enumerate(key):
            same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
        out = out.join(whole, same, "left_semi")
    return out.drop("_n")


def capped_turns(rows: DataFrame, speaker: str, duration: str, order: Sequence[str], cap: int | None) -> DataFrame:
    """`rows` with turn: the place, from 1, at which a speaker's row is taken in its order.

    Without a cap that is its rank. With one, rows that would take the speaker beyond it are
    passed over for good, which depends on all rows before; a speaker's rows are read in order
    and only two numbers are carried, so any length passes through.
    """
    if cap is None:
        return rows.withColumn("turn", F.row_number().over(Window.partitionBy(speaker).orderBy(*order)).cast("long"))
    schema = StructType(list(rows.schema.fields)).add("turn", LongType())
    dealt = rows.repartition(speaker).sortWithinPartitions(speaker, *order)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, used, turn = None, 0, 0
        for pdf in batches:
            turns = []
            for s, d in zip(pdf[speaker], pdf[duration]):
                if s != who:
                    who, used, turn = s, 0, 0
                taken = used + d <= cap
                used, turn = (used + d, turn + 1) if taken else (used, turn)
                turns.append(turn if taken else None)
            pdf["turn"] = pd.array(turns, dtype="Int64")
            yield pdf[pdf["turn"].notna()]

    return dealt.mapInPandas(each, schema)


def round_robin(rows: DataFrame, speaker: str, duration: str, order: Sequence[str], target: int | None = None, cap: int | None = None, count: int | None = None) -> DataFrame:
    """Rows taken speaker by speaker, one a turn, until a total duration or a count is met.

    position is the place in the order taken. If the rows don't reach target or count, the
    result is empty.
    """
    turns = capped_turns(rows, speaker, duration, order, cap)
    placed = global_index(turns, ["turn", speaker], "position")
    if count is not None:
        placed = placed.where(F.col("position") <= count)
    if target is not None:
        placed = running_sum(placed, ["turn", speaker], duration, "_so_far").where(F.col("_so_far") < target).drop("_so_far")
    met = placed.agg(F.count("*").alias("n"), F.coalesce(F.sum(duration), F.lit(0)).alias("ms"))
    enough = (F.lit(count is None) | (F.col("n") >= (count or 0))) & (F.lit(target is None) | (F.col("ms") >= (target or 0)))
    return placed.join(F.broadcast(met.where(enough).select(F.lit(True).alias("_ok"))), F.col("_ok")).drop("_ok")


def stratified_round_robin(rows: DataFrame, stratum: str, rank: Column, tie: str, most: int, passed: str = "passed") -> tuple[DataFrame, DataFrame]:
    """(selected, rejected): `most` passing rows taken stratum by stratum in rank order, and the
    failing rows that were looked at on the way.

    A stratum looks at its rows in rank order and takes the next that passes. It is visited again
    after its last taken row only while fewer than `most` were taken before that visit; then
    it looks on to its end or next passing row, else only up to its last taken row.
    """
    by = Window.partitionBy(stratum).orderBy(rank, F.col(tie))
    seen = rows.withColumn("_at", F.row_number().over(by)).withColumn("_ok", F.col(passed).cast("int"))
    seen = seen.withColumn("turn", F.sum("_ok").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    taken = global_index(seen.where(F.col(passed)), ["turn", stratum], "position").where(F.col("position") <= most)
    last = taken.groupBy(stratum).agg(F.max("turn").alias("_last"))
    # the position that the stratum's next visit would have: rows taken in rounds up to its turn
    # in the next round, and a round after one without progress never comes
    # the next visit of a stratum stands behind its last taken row, at (its last turn + 1, itself):
    # how many rows were taken before it is a running count over taken rows and visits together
    strata = rows.select(stratum).distinct().join(last, stratum, "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
    marks = taken.select("turn", stratum, F.lit(1).cast("long").alias("_taken")).unionByName(
        strata.select((F.col("_last") + 1).alias("turn"), stratum, F.lit(0).cast("long").alias("_taken"))
    )
    visit = running_sum(marks, ["turn", stratum], "_taken", "_ahead").where("_taken = 0").withColumn("_last", F.col("turn") - 1).drop("turn", "_taken")
    rounds_run = taken.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0] + 1
    again = (F.col("_ahead") < most) & (F.col("_last") + 1 <= rounds_run)
    looked = seen.where(~F.col(passed)).join(visit.withColumn("_again", again), stratum)
    rejected = looked.where((F.col("turn") < F.col("_last")) | (F.col("_again") & (F.col("turn") == F.col("_last"))))
    keep = rows.columns
    return taken.select(*keep, "position"), rejected.select(*keep)


def anchor_slice(rows: DataFrame, order: str, step: int, k: int) -> DataFrame:
    """The k rows, in cycle, that step `step` (from 1) takes from the ordered anchors, with offset."""
    placed = global_index(rows, [order], "_n")
    n = placed.count()
    if not n:
        return placed.withColumn("offset", F.lit(0)).drop("_n")
    offsets = [((step - 1) * k + o) % n + 1 for o in range(k)]
    wanted = rows.sparkSession.createDataFrame(list(enumerate(offsets)), "offset int, _n long")
    return placed.join(wanted, "_n").drop("_n")


def stage_deltas(metrics: DataFrame, stage: str, order: Column, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """`metrics` with delta_base and delta_previous over the stages' order; the first has 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return metrics.withColumns({
        "delta_base": F.col(value) - F.first(value).over(w),
        "delta_previous": F.col(value) - F.coalesce(F.lag(value).over(w), F.col(value)),
    })


def best_checkpoint(decisions: DataFrame) -> DataFrame:
    """The passed row with the lowest degraded macro rate, then clean rate, then step; none if none passed."""
    return decisions.where("passed").orderBy("degraded_macro_cer", "clean_cer", "step").limit(1)


def zero_signal_runs(visits: DataFrame, run: str, order: str, zero: Column) -> DataFrame:
    """`visits` with consecutive: how many rows without signal stand in a row up to this one."""
    w = Window.partitionBy(run).orderBy(order)
    island = F.sum((~zero).cast("int")).over(w)
    rows = visits.withColumns({"_zero": zero, "_island": island})
    so_far = Window.partitionBy(run, "_island").orderBy(order)
    return rows.withColumn("consecutive", F.sum(F.col("_zero").cast("long")).over(so_far)).drop("_zero", "_island")


def invalid_rate_at(visits: DataFrame, run: str, order: str, invalid: str, at: int = 100) -> DataFrame:
    """Rows (run, invalid_rate) of runs that have reached exactly the visit of the check."""
    n = visits.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(order))).where(F.col("_n") <= at)
    return n.groupBy(run).agg(F.avg(F.col(invalid).cast("double")).alias("invalid_rate"), F.max("_n").alias("_n")).where(F.col("_n") == at).drop("_n")


def prune_checkpoints(checkpoints: DataFrame, keep: int, current: int | None = None) -> DataFrame:
    """The checkpoints to delete: all but the last `keep` and the current one."""
    stay = checkpoints.orderBy(F.desc("step")).limit(keep).select("step")
    gone = checkpoints.join(stay, "step", "left_anti")
    return gone if current is None else gone.where(F.col("step") != current)
