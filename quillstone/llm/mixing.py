"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import WORD, cut, running_total

#: Rows alike in all of these are a unit; `h` is a hash of the text.
UNIT = ["doc_id", "source", "size", "h"]


def word_count(text: str = "text"):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Rows (source, source_size, units, target) for `units(source, size, m)`.

    Sources by code point (null last) take `weights` in turn and share the sum of all sizes.
    A target above `max_repeat` times its source's size stops there; the excess goes to the
    others by weight. As a source is full once the common rate reaches cap / weight, the full
    ones are the first in the order of that ratio, and one pass over running totals finds them.
    """
    per = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("units")
    )
    ranked = running_total(per, [F.col("source")], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeat))
    ranked = running_total(
        ranked, [F.col("cap") / F.col("weight"), F.col("source")], {"cap": F.col("cap"), "weight": F.col("weight")}, "_sum_"
    )
    ranked = cut(ranked)
    total, weight_sum = ranked.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first()
    full = (F.col("cap") / F.col("weight")) * (F.lit(weight_sum or 0.0) - F.col("_sum_weight")) <= F.lit(total or 0.0) - F.col("_sum_cap")
    ranked = ranked.withColumn("_full", full)
    used, free = ranked.agg(
        F.sum(F.when(F.col("_full"), F.col("cap"))), F.sum(F.when(~F.col("_full"), F.col("weight")))
    ).first()
    rate = ((total or 0.0) - (used or 0.0)) / free if free else 0.0
    target = F.when(F.col("_full"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * rate))
    return ranked.select("source", "source_size", "units", target.alias("target"))


def _pivotal(rows: list[list], seed: int) -> None:
    """Round the fractions p of rows [key, size, copies, p, open] in place; one may stay open.

    Two open rows exchange words until one fraction is 0 or 1: the direction is drawn so that
    each fraction keeps its expectation, and the sum of size * p never changes. A row that is
    left open against smaller ones hands its remainder down to them.
    """
    rows.sort(key=lambda r: (-r[1], r[0]))
    base = [r[2] for r in rows]
    hand = None
    for row in rows:
        if hand is None:
            hand = row
            continue
        up = min(hand[1] * (1 - hand[3]), row[1] * row[3])
        down = min(row[1] * (1 - row[3]), hand[1] * hand[3])
        draw = random.Random(f"{seed}:{hand[0]}:{row[0]}").random()
        move = up if draw * (up + down) < down else -down
        hand[3] += move / hand[1]
        row[3] -= move / row[1]
        left = []
        for r in (hand, row):
            if r[3] < 1e-9 or r[3] > 1 - 1e-9:
                r[2] += int(r[3] > 0.5)
                r[3], r[4] = 0.0, False
            else:
                left.append(r)
        hand = left[0] if left else None
    if hand is not None and rows[-1][1] < hand[1]:
        _hand_down(rows, base, hand, random.Random(f"{seed}:{hand[0]}").random() < hand[3])


def _hand_down(rows: list[list], base: list[int], hand: list, up: bool) -> None:
    """Close the open row `hand` against rows already closed, so that a small one is left open.

    Going up it takes the words that it lacks from rows that were rounded up, going down it
    gives those it has to rows that were rounded down; the largest that still fit change whole,
    and the smallest that exceeds the rest reopens with what is left. The sum stays.
    """
    rest = hand[1] * (1 - hand[3] if up else hand[3])
    can = [r for r, b in zip(rows, base) if r is not hand and r[1] < hand[1] and r[2] - b == int(up)]
    for r in can:
        if 0 < r[1] <= rest:
            r[2] += -1 if up else 1
            rest -= r[1]
            r[4] = None
    hand[2] += int(up)
    hand[3], hand[4] = 0.0, False
    if rest > 1e-9 * hand[1]:
        last = next((r for r in reversed(can) if r[4] is False and r[1] > rest), hand)
        last[2] -= int(up)
        last[3] = 1 - rest / last[1] if up else rest / last[1]
        last[4] = True
    for r in can:
        r[4] = bool(r[4])


def pivotal_tree(units: DataFrame, chunk: int, fan_in: int, seed: int) -> DataFrame:
    """How many of its m rows each of `units(doc_id, source, size, h, m, units, copies, p)` rounds up: rows (*UNIT, up).

    Of m equal rows of fraction p, floor(m p) go up and one row stands for what is left, so a group of copies
    is rounded like as many single rows. Leaves of about `chunk` such rows of one source are rounded on their own
    and leave at most one open row each; these meet `fan_in` at a time, level by level, until each source has
    one, which goes to the nearer whole number. A source with many units has many leaves, so none is one task's work.
    """
    leaves = F.greatest(F.ceil(F.col("units") / chunk), F.lit(1))
    schema = "doc_id long, source string, size long, h long, leaf long, base long, copies long, p double, open boolean"

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [f"{d}:{s}:{k}:{h}" for d, s, k, h in zip(pdf["doc_id"], pdf["source"], pdf["size"], pdf["h"])]
        rows = [[k, int(s), int(c), float(p), True] for k, s, c, p in zip(keys, pdf["size"], pdf["copies"], pdf["p"])]
        _pivotal(list(rows), seed)
        pdf = pdf.copy()
        pdf["copies"], pdf["p"], pdf["open"] = [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]
        return pdf

    weightless = F.when(F.col("p") > 0.5, F.col("m")).otherwise(F.lit(0))
    whole = F.floor(F.col("m") * F.col("p") + 1e-9)
    units = units.withColumn("base", F.when(F.col("size") > 0, whole).otherwise(weightless).cast("long"))
    left = F.when(F.col("size") > 0, F.col("m") * F.col("p") - F.col("base")).otherwise(F.lit(0.0))
    units = units.withColumn("p", left)
    fixed = F.col("p").between(1e-9, 1 - 1e-9)
    todo = units.where(fixed).select(
        *UNIT, F.pmod(F.xxhash64("doc_id", "size", "h", F.lit(seed)), leaves).alias("leaf"), "base", F.col("base").alias("copies"), "p", F.lit(True).alias("open")
    )
    widest = units.agg(F.max(leaves)).first()[0] or 1
    done = [units.where(~fixed).select(*UNIT, F.col("base").alias("up"))]
    while True:
        level = cut(todo.groupBy("source", "leaf").applyInPandas(settle, schema))
        done.append(level.where(~F.col("open")).select(*UNIT, F.col("copies").alias("up")))
        todo = level.where("open").withColumn("leaf", F.floor(F.col("leaf") / fan_in))
        if widest == 1:
            break
        widest = -(-widest // fan_in)
    # the one row that a source may have left goes to the nearer whole number
    done.append(todo.select(*UNIT, (F.col("copies") + (F.col("p") >= 0.5).cast("long")).alias("up")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """`rows(unit, row, m, up, ...)` with `more`: true for `up` of the m rows of each unit, for units of which some but not all go up.

    Equal rows are numbered by the task that holds them and within it, so a large unit is numbered in many tasks.
    """
    rows = cut(rows.withColumn("part", F.spark_partition_id()))
    key = ["unit", "part"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*key, before.alias("before"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("part"))
    return rows.join(counts, key).withColumn("more", number + F.col("before") <= F.col("up")).drop("part", "before")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, chunk: int = 2048, fan_in: int = 64, seed: int = 42
) -> DataFrame:
    """`docs` with size, source_size, target and copies (how often the mix takes the row).

    A row's expected copies are its source's target over its source's size: the whole part is
    taken, the fraction is rounded by `pivotal_tree`. Of rows alike in (doc_id, source, text), as
    many are rounded up as their fractions make; which of them is open, as they are alike. Null texts have
    size 0; rows of size 0 have no weight and take the nearest whole number of copies; null
    sources are one source; an empty table gives an empty one. Other columns pass through under
    any name, except that input columns named like an added one go.
    """
    added = ("size", "source_size", "target", "copies")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), F.xxhash64("text").alias("h"))
    out = mix_sized(rows, weights, max_repeat, chunk, fan_in, seed)
    return out.select("row.*", *added)


def mix_sized(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, chunk: int = 2048, fan_in: int = 64, seed: int = 42) -> DataFrame:
    """As `mix_sources`, for `rows(row, doc_id, source, size, h)` whose words are counted: (row, *UNIT, source_size, target, copies)."""
    units = cut(rows.groupBy(*UNIT).agg(F.count("*").alias("m")))
    targets = cut(source_targets(units, weights, max_repeat))
    targets = targets.withColumnRenamed("source", "_src")
    rated = units.join(targets, F.col("source").eqNullSafe(F.col("_src")))
    expect = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rated = cut(rated.withColumns({"copies": F.floor(expect), "p": expect - F.floor(expect)}).drop("_src"))
    unit = F.struct(*UNIT).alias("unit")
    decided = pivotal_tree(rated, chunk, fan_in, seed).select(unit, "up")
    rated = rated.select(unit, "m", "source_size", "target", "copies")
    decided = cut(rated.join(decided.withColumnRenamed("unit", "_unit"), F.col("unit").eqNullSafe(F.col("_unit"))).drop("_unit"))
    every = rows.select("row", unit).join(decided.withColumnRenamed("unit", "_unit"), F.col("unit").eqNullSafe(F.col("_unit"))).drop("_unit")
    alike = every.where("up = 0 OR up = m").withColumn("more", F.col("up") > 0)
    if not decided.where("up > 0 AND up < m").isEmpty():
        alike = alike.unionByName(_dealt(every.where("up > 0 AND up < m")))
    return alike.select("row", "unit.*", "source_size", "target", (F.col("copies") + F.col("more").cast("long")).alias("copies"))


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, without the added columns."""
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    kept = [F.col(f"`{c}`") for c in mixed.columns if c not in ("size", "source_size", "target", "copies")]
    return mixed.where("copies > 0").select(F.struct(*kept).alias("row"), again).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.lit(None).cast("int").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), F.xxhash64("text").alias("h"))
    return mix_sized(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
