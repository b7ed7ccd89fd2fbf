"""Joins with contracts: strict one-to-one, intervals, near/far bands, read-back, lineage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import first_of, is_blank
from quillstone.shared import cut


class ContractError(ValueError):
    """Rows that break a join's contract; `violations` is the DataFrame that lists them."""

    def __init__(self, message: str, violations: DataFrame):
        super().__init__(message)
        self.violations = violations


def join_violations(left: DataFrame, right: DataFrame, key: str, same: Sequence[str] = ()) -> DataFrame:
    """Rows (key, code) where a one-to-one join on `key` would not be one.

    Codes: blank_left, blank_right, duplicate_left, duplicate_right, missing_right (a left key
    without partner), extra_right, and mismatch_<column> for columns that both sides must agree
    in where the right one has a value. Each side is reduced to one row a key before they meet.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        pick = [F.first(c).alias(f"{p}_{c}") for c in same if c in df.columns]
        return df.groupBy(F.col(key).alias(key)).agg(F.count("*").alias(f"{p}_n"), *pick)

    a, b = side(left, "l"), side(right, "r")
    both = a.join(b, a[key].eqNullSafe(b[key]), "full_outer").select(F.coalesce(a[key], b[key]).alias(key), *[c for c in a.columns + b.columns if c != key])
    blank = is_blank(F.col(key).cast("string"))
    codes = [
        F.when(blank & (F.col("l_n") > 0), "blank_left"),
        F.when(blank & (F.col("r_n") > 0), "blank_right"),
        F.when(~blank & (F.col("l_n") > 1), "duplicate_left"),
        F.when(~blank & (F.col("r_n") > 1), "duplicate_right"),
        F.when(~blank & F.col("r_n").isNull(), "missing_right"),
        F.when(~blank & F.col("l_n").isNull(), "extra_right"),
    ]
    for c in same:
        if f"l_{c}" in both.columns and f"r_{c}" in both.columns:
            codes.append(F.when(F.col("l_n").isNotNull() & F.col(f"r_{c}").isNotNull() & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), f"mismatch_{c}"))
    return both.select(key, F.explode(F.array_compact(F.array(*codes))).alias("code"))


def strict_one_to_one(left: DataFrame, right: DataFrame, key: str, same: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Inner join that raises ContractError unless every key has one row on either side.

    Of columns on both sides the left one stays.
    """
    if check:
        bad = join_violations(left, right, key, same)
        counts = {r["code"]: r["n"] for r in bad.groupBy("code").agg(F.count("*").alias("n")).collect()}
        if counts:
            raise ContractError(f"join on {key} is not one to one: {counts}", bad)
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c != key]), key)


def missing_either(left: DataFrame, right: DataFrame, key: str, left_code: str, right_code: str, duplicate_code: str) -> DataFrame:
    """Rows (key, reason) of a full outer join: keys of one side only, and duplicated right keys.

    A duplicated right key is taken out first, so its left row then lacks a partner as well.
    """
    right = right.groupBy(key).agg(F.count("*").alias("_n"))
    once = right.where("_n = 1").select(key, F.lit(True).alias("_r"))
    both = left.select(key, F.lit(True).alias("_l")).join(once, key, "full_outer")
    gone = both.select(key, F.when(F.col("_r").isNull(), left_code).when(F.col("_l").isNull(), right_code).alias("reason"))
    return gone.where("reason is not null").unionByName(right.where("_n > 1").select(key, F.lit(duplicate_code).alias("reason")))


_REACH = "grp string, part int, far1 double, own1 string, far2 double, near1 double, nown1 string, near2 double"


class _Two:
    """The best value so far and the best of any other owner; `better` is max or min."""

    def __init__(self, better) -> None:
        self.better, self.best, self.owner, self.other = better, None, None, None

    def add(self, value: float | None, owner: str | None) -> None:
        if value is None:
            return
        if self.best is None or owner == self.owner:
            self.best, self.owner = value if self.best is None else self.better(self.best, value), owner
        elif self.better(value, self.best) == value:
            self.best, self.owner, self.other = value, owner, self.best
        else:
            self.other = value if self.other is None else self.better(self.other, value)

    def of_others(self, owner: str) -> float | None:
        return self.other if owner == self.owner else self.best


def interval_overlaps(intervals: DataFrame, group: str, owner: str, eps: float) -> DataFrame:
    """Ids (distinct) of `intervals(id, group, owner, xmin, xmax)` that another owner's overlaps by more than `eps`.

    A sweep in order of the starts instead of a join: an interval is met by one that starts before it
    if the farthest end of another owner lies more than eps behind its start, and by one that starts
    after it if the next start of another owner lies more than eps before its end. Rows are dealt by
    range of (group, start), so a group may lie in many tasks; what crosses their borders is the two
    farthest ends, and the two nearest starts, of two owners: two rows a task at most, sent to all of them.
    Each task streams its rows and keeps only those still waiting for a start of another owner.
    Intervals of eps or less match nothing; rows with a null group, owner or time neither.
    """
    if eps < 0:
        raise ValueError("eps must not be negative")
    rows = intervals.select(F.col("id"), F.col(group).cast("string").alias("grp"), F.col(owner).cast("string").alias("own"), F.col("xmin").cast("double").alias("xmin"), F.col("xmax").cast("double").alias("xmax"))
    rows = rows.where("grp is not null and own is not null").where((F.col("xmax") - F.col("xmin") > eps) & ~F.isnan("xmin") & ~F.isnan("xmax"))
    dealt = rows.repartitionByRange("grp", "xmin").sortWithinPartitions("grp", "xmin")
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, key, part = [], None, None
        far = near = None
        for pdf in batches:
            for g, p, o, a, b in zip(pdf["grp"], pdf["part"], pdf["own"], pdf["xmin"], pdf["xmax"]):
                if g != key:
                    if key is not None:
                        out.append((key, part, far.best, far.owner, far.other, near.best, near.owner, near.other))
                    key, part, far, near = g, p, _Two(max), _Two(min)
                far.add(b, o)
                near.add(a, o)
        if key is not None:
            out.append((key, part, far.best, far.owner, far.other, near.best, near.owner, near.other))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _REACH.split(", ")])

    parts = dealt.mapInPandas(reach, _REACH)
    spans = cut(parts.join(parts.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp"), "grp"))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row a task that holds the group: what lies before and after each
        pdf = pdf.sort_values("part")
        none = lambda x: None if x is None or x != x else x
        out = {p: [None] * 6 for p in pdf["part"]}
        for frame, better, at, names in ((pdf, max, 0, ("far1", "own1", "far2")), (pdf[::-1], min, 3, ("near1", "nown1", "near2"))):
            held = _Two(better)
            for row in frame.itertuples(index=False):
                out[row.part][at : at + 3] = [held.best, held.owner, held.other]
                best, name, other = (none(getattr(row, n)) for n in names)
                held.add(best, name)
                held.add(other, None if other is None else f"\0{name}")  # some owner that isn't `name`
        return pd.DataFrame([(pdf["grp"].iloc[0], p, *v) for p, v in out.items()], columns=[c.split()[0] for c in _REACH.split(", ")])

    carried = spans.groupBy("grp").applyInPandas(carry, _REACH)
    # two rows a task at most: its first and its last group
    met = dealt.join(F.broadcast(carried), ["grp", "part"], "left").select("id", "grp", "own", "xmin", "xmax", "far1", "own1", "far2", "near1", "nown1", "near2")
    kind = dict(rows.dtypes)["id"]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, far, after, waiting = None, None, None, []  # all that wait are of one owner
        hits: list = []
        most = 1024

        def close() -> None:
            for i, o, b in waiting:
                start = after.of_others(o)
                if start is not None and b - start > eps:
                    hits.append(i)
            waiting.clear()

        for pdf in batches:
            for i, g, o, a, b, *c in pdf.itertuples(index=False, name=None):
                if g != key:
                    if key is not None:
                        close()
                    c = [None if x is None or x != x else x for x in c]
                    key, far, after = g, _Two(max), _Two(min)
                    far.best, far.owner, far.other = c[:3]
                    after.best, after.owner, after.other = c[3:]
                if waiting and waiting[0][1] != o:
                    # those whose end lies before this start have none left to wait for either
                    hits.extend(w[0] for w in waiting if w[2] - a > eps)
                    waiting.clear()
                before = far.of_others(o)
                if before is not None and min(b, before) - a > eps:
                    hits.append(i)
                else:
                    if len(waiting) >= most:
                        waiting[:] = [w for w in waiting if w[2] - a > eps]
                        most = max(1024, 2 * len(waiting))
                    waiting.append((i, o, b))
                far.add(b, o)
            yield pd.DataFrame({"id": hits})
            hits = []
        if key is not None:
            close()
            yield pd.DataFrame({"id": hits})

    return met.mapInPandas(sweep, f"id {kind}").distinct()


def band_match(near: DataFrame, far: DataFrame, keys: Sequence[str], drift: float, diff: float) -> DataFrame:
    """`near(id, speaker, xmin, xmax)` with matches, far_id and reason, matched to `far` on `keys`.

    A far row fits if its speaker is null or the same, its start lies within `drift` and its
    duration within `diff`. Rows of the same speaker are preferred over those without; exactly
    one must remain. Starts are binned by `drift`, so the band is an equi-join on three bins.
    """
    cell = lambda c: F.floor(c / drift)
    n = near.withColumn("_cell", F.explode(F.array(*[cell(F.col("xmin")) + k for k in (-1, 0, 1)])))
    f = far.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("_id"), F.col("speaker").alias("_s"), F.col("xmin").alias("_a"), F.col("xmax").alias("_b"), cell(F.col("xmin")).alias("_c"))
    on = F.col("_cell") == F.col("_c")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    length = lambda a, b: F.col(b) - F.col(a)
    fits = (F.col("_s").isNull() | (F.col("_s") == F.col("speaker"))) & (F.abs(F.col("xmin") - F.col("_a")) <= drift)
    fits = fits & (F.abs(length("xmin", "xmax") - length("_a", "_b")) <= diff)
    exact = F.col("_s") == F.col("speaker")
    met = n.join(f, on & fits).groupBy("id").agg(
        F.count_if(exact).alias("_exact"), F.count("*").alias("_any"),
        F.min(F.when(exact, F.col("_id"))).alias("_exact_id"), F.min("_id").alias("_any_id"),
    )
    one = F.when(F.col("_exact") > 0, F.col("_exact")).otherwise(F.coalesce("_any", F.lit(0)))
    return near.join(met, "id", "left").select(
        *near.columns, one.alias("matches"),
        F.when(one == 1, F.when(F.col("_exact") > 0, F.col("_exact_id")).otherwise(F.col("_any_id"))).alias("far_id"),
        F.when(one != 1, "unpaired_far_interval").alias("reason"),
    )


def readback_diff(expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows (key, problem): missing, extra, or the columns that differ, comma-joined; nulls are equal."""
    a = expected.select(F.col(key), *[F.col(c).alias(f"_e_{c}") for c in columns], F.lit(True).alias("_e"))
    b = actual.select(F.col(key), *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_a"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_e_{c}").eqNullSafe(F.col(f"_a_{c}")), c) for c in columns]))
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise(F.nullif(F.array_join(differ, ","), F.lit("")))
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def against_index(rows: DataFrame, index: DataFrame, path: str = "audio", sha: str = "sha256") -> DataFrame:
    """`rows` with problem: missing where the index lacks the path, mismatch where the digest differs."""
    known = index.groupBy(F.col("name").alias("_name")).agg(F.max("sha256").alias("_sha"))
    problem = first_of((F.col("_name").isNull(), "missing"), (~F.col(sha).eqNullSafe(F.col("_sha")), "mismatch"))
    return rows.join(known, F.col(path) == F.col("_name"), "left").select(*rows.columns, problem.alias("problem"))


def lineage_breaks(releases: DataFrame) -> DataFrame:
    """Rows (release, problem) of `releases(release, parent, parent_sha, adapter_sha)` whose parent is absent or changed."""
    up = releases.select(F.col("release").alias("_r"), F.col("adapter_sha").alias("_s"))
    problem = first_of(
        (F.col("parent").isNotNull() & F.col("_r").isNull(), "unknown_parent"),
        (F.col("_r").isNotNull() & ~F.col("parent_sha").eqNullSafe(F.col("_s")), "parent_sha_mismatch"),
    )
    return releases.join(up, F.col("parent") == F.col("_r"), "left").select("release", problem.alias("problem")).where("problem is not null")


def incomplete_sources(rows: DataFrame, source: str, scenario: str, wanted: Sequence[str], text: str = "text") -> DataFrame:
    """Rows (source, problem): a source without each wanted scenario once, or whose texts differ."""
    per = rows.groupBy(source).agg(F.count("*").alias("n"), F.collect_set(F.when(F.col(scenario).isin(*wanted), F.col(scenario))).alias("have"), F.count_distinct(text).alias("texts"))
    problem = first_of(((F.size("have") < len(wanted)) | (F.col("n") != len(wanted)), "scenarios"), (F.col("texts") != 1, "text"))
    return per.select(source, problem.alias("problem")).where("problem is not null")


def attach(rows: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Many-to-one: `rows` with the columns of `meta`; unknown keys are dropped, a key of two rows raises."""
    rest = [c for c in meta.columns if c != key]
    one = meta.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    sure = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("two rows of metadata: "), F.col(key).cast("string"))).cast("boolean"))
    return rows.join(one.where(sure).drop("_n"), key)


def files_by_stem(near: DataFrame, grids: DataFrame, far: DataFrame, stem: Column, meeting: Column) -> DataFrame:
    """Near recordings with their annotation (same stem) and far recording (meeting id, else stem)."""
    n = near.select("path", stem.alias("stem"), meeting.alias("meeting"))
    g = grids.select(stem.alias("stem"), F.col("path").alias("grid"))
    f = far.select(F.col("path").alias("far"), meeting.alias("meeting"), stem.alias("_stem"))
    by_meeting = f.groupBy("meeting").agg(F.min("far").alias("_far_m"))
    by_stem = f.groupBy(F.col("_stem").alias("stem")).agg(F.min("far").alias("_far_s"))
    out = n.join(g, "stem", "left").join(by_meeting, "meeting", "left").join(by_stem, "stem", "left")
    return out.select("path", "stem", "meeting", "grid", F.coalesce("_far_m", "_far_s").alias("far"))
