"""Release logs: append-only events folded to states, with the reason of every refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import first_of


def _first(log: DataFrame, event: str, name: str, *extra: Column) -> DataFrame:
    """The earliest place of `event` for each release, as `name`."""
    return log.where(F.col("event") == event).groupBy("release").agg(F.min(F.struct("place", *extra)).alias(name)).select(F.col("release").alias(f"_{name}"), name)


def _with(log: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return log.join(found, F.col("release").eqNullSafe(F.col(f"_{name}")), "left").drop(f"_{name}")


def judged_events(log: DataFrame) -> DataFrame:
    """`log(release, logged_at, id, event, payload_sha, matched, compared, saved_rows)` with accepted, reason and status after each event.

    A release is staged once; a read-back of the staged payload that compares every saved row and
    finds all alike verifies it; then it can be published, once, with the payload unchanged. Refused events change nothing:
    already_exists, not_staged, partial_readback, payload_changed, not_verified, already_published,
    unknown_event. Status is none, staged, verified or published. Events go by (logged_at, id).

    What an event meets depends on three places only, where its release was first staged,
    verified and published, so the fold is three minima a release and no task walks through a log.
    """
    log = log.withColumn("place", F.struct("logged_at", "id"))
    log = _with(log, _first(log, "stage", "staged", "payload_sha"), "staged")
    same = F.col("payload_sha").eqNullSafe(F.col("staged.payload_sha"))
    whole = F.coalesce(F.col("matched") & (F.col("compared") == F.col("saved_rows")), F.lit(False))
    after = lambda name: F.col(name).isNotNull() & (F.col("place") > F.col(f"{name}.place"))
    log = _with(log, _first(log.where(after("staged") & whole & same), "readback", "verified"), "verified")
    log = _with(log, _first(log.where(after("verified") & same), "publish", "published"), "published")
    known = F.col("event").isin("stage", "readback", "publish")
    later = F.col("event") != "stage"
    reason = first_of(
        (~F.coalesce(known, F.lit(False)), "unknown_event"), (~later & (F.col("place") != F.col("staged.place")), "already_exists"), (later & ~after("staged"), "not_staged"),
        (later & after("published"), "already_published"), ((F.col("event") == "readback") & ~whole, "partial_readback"),
        ((F.col("event") == "publish") & ~after("verified"), "not_verified"), (later & ~same, "payload_changed"),
    )
    reached = lambda name: F.col(name).isNotNull() & (F.col("place") >= F.col(f"{name}.place"))
    status = F.when(reached("published"), "published").when(reached("verified"), "verified").when(reached("staged"), "staged").otherwise("none")
    return log.withColumns({"reason": reason, "status": status}).withColumn("accepted", F.col("reason").isNull()).drop("place", "staged", "verified", "published")


def current(log: DataFrame) -> DataFrame:
    """Rows (release, status, refused): where each release stands, and how many of its events were refused."""
    order = F.create_map(*[F.lit(x) for pair in (("none", 0), ("staged", 1), ("verified", 2), ("published", 3)) for x in pair])
    rows = judged_events(log).withColumn("_n", order[F.col("status")])
    return rows.groupBy("release").agg(F.max_by("status", "_n").alias("status"), F.count_if(~F.col("accepted")).alias("refused"))
