"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.shared import cut, scratch, shared_dir  # noqa: F401 - for the operators

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lean(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back to the system when it ends.

    Python workers outlive their tasks and would keep what a task's texts and memories took.
    """

    def run(batches: Iterator) -> Iterator:
        yield from each(batches)
        gc.collect()
        release()

    return run


def release() -> None:
    """Give freed memory back to the system now."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def running_total(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], prefix: str = "before_") -> DataFrame:
    """Add `before_<name>`: the sum of each expression over all rows that sort earlier.

    Rows are dealt by range, summed per partition, and offset by the totals of the earlier
    partitions (one row each), so no task sees more than one range. `order` must be unique.
    """
    names = list(sums)
    parts = df.withColumns({f"_v_{n}": c for n, c in sums.items()}).withColumns({f"_o_{i}": c for i, c in enumerate(order)})
    keys = [f"_o_{i}" for i in range(len(order))]
    parts = cut(parts.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys]).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names])
    within = Window.partitionBy("_part").orderBy(*[F.col(k).asc_nulls_last() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(base, "_part").withColumns(
        {f"{prefix}{n}": F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) for n in names}
    )
    return out.drop("_part", *keys, *[f"_{k}_{n}" for n in names for k in "vb"])


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of `edges(a long, b long)`: rows (node, root).

    Alternating large-star and small-star steps: every node links its larger neighbours, and
    then its smaller ones, to the smallest it knows, until nothing changes. Each step is one
    grouping whose minimum is combined before the shuffle and one equi-join, and is written to
    the shared folder; edges never grow in number and never reach the driver. Hubs, of which there
    can be a bounded number only, are sent to the edges instead of gathering theirs in one task.
    Nodes without edges are absent.
    """
    spark = edges.sparkSession
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    # edges never grow in number, so at most 2,000 nodes have more neighbours than this
    hub = max(512, now.count() // 1000)
    state = None
    while True:
        large = _star(now, True, hub)
        small = cut(_star(large, False, hub))
        seen = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state, now = seen, small
    spark.catalog  # the session stays referenced while the last table is read
    roots = small.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _star(edges: DataFrame, larger: bool, hub: int) -> DataFrame:
    """One star step over edges with a > b.

    large: each node u links all its larger neighbours to min(neighbours, u).
    small: each node u links its smaller neighbours and itself to min(neighbours).
    Nodes of more than `hub` edges meet their edges by broadcast: no task holds all of them.
    """
    if larger:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # only the edges to larger neighbours are kept: (b, a)
        near, own = edges.select(F.col("b").alias("u"), F.col("a").alias("v")), None
    else:
        low = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
        near, own = edges.select(F.col("a").alias("u"), F.col("b").alias("v")), low.select(F.col("u").alias("a"), F.col("m").alias("b"))
    few = F.broadcast(low.where(F.col("n") > hub).select("u", F.col("m").alias("hub_m")))
    marked = near.join(few, "u", "left")
    out = marked.where("hub_m is not null").select(F.col("v").alias("a"), F.col("hub_m").alias("b")).unionByName(
        marked.where("hub_m is null").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    )
    if own is not None:
        out = out.unionByName(own)
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
