"""Repair of conversation structure: turns as min-plus matrices, multiplied up a tree.

A turn is a 4x4 matrix over (cost, audit): the cheapest way, with the ASCII-least edits among
equally cheap ones, to get from one state of the grammar `(s?(ua)+)?` to another over it. Such
pairs add as (cost + cost, audit + audit) and the lesser is taken, which is associative, so runs
of turns are multiplied wherever they lie and their products meet in a tree. (Of two equally
cheap audits of the same turns none is the other's beginning, as each insertion costs, so the
lesser stays the lesser whatever follows.)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, lean

# States (nothing yet, after the system turn, after user, after assistant) and costs.
STATES = 4
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = ("su", "ua", "au")

Matrix = list  # 16 pairs (cost, audit) or None, row by row
_SOLID = re.compile(r"[^\x20\x09-\x0D]")


def multiply(x: Matrix, y: Matrix) -> Matrix:
    """The matrix of what `x` covers followed by what `y` covers."""
    out: Matrix = [None] * (STATES * STATES)
    for i in range(STATES):
        for k in range(STATES):
            if (a := x[i * STATES + k]) is None:
                continue
            for j in range(STATES):
                if (b := y[k * STATES + j]) is None:
                    continue
                at, cost = i * STATES + j, a[0] + b[0]
                now = out[at]
                if now is None or cost < now[0] or (cost == now[0] and a[1] + b[1] < now[1]):
                    out[at] = (cost, a[1] + b[1])
    return out


def lesser(x: Matrix, y: Matrix) -> Matrix:
    return [min((p for p in pair if p is not None), default=None) for pair in zip(x, y)]


def closure(step: Matrix) -> Matrix:
    """Any number of repetitions of `step`, none included; its steps must cost something."""
    out = [(0, "") if i // STATES == i % STATES else None for i in range(STATES * STATES)]
    for _ in range(STATES):
        out = lesser(out, multiply(out, step))
    return out


def _step(moves: dict[str, dict[int, int]], kinds: str, cost: int, letter: str) -> Matrix:
    out: Matrix = [None] * (STATES * STATES)
    for kind in kinds:
        for i, j in moves[kind].items():
            out[i * STATES + j] = (cost, letter)
    return out


INSERTS = closure(_step(NEXT, "ua", INSERT, "I"))
UNIT = closure([None] * (STATES * STATES))
DROP = [(DELETE, "D") if i // STATES == i % STATES else None for i in range(STATES * STATES)]


def turn_matrix(initial: str, must_go: bool, truncated: bool) -> Matrix:
    """Insertions, then one edit of a turn whose role begins with `initial`."""
    edit = DROP
    if not must_go:
        more = TRUNCATED * truncated
        edit = lesser(edit, _step(NEXT, "ua", REROLE + more, "R"))
        if initial in NEXT:
            edit = lesser(edit, _step(NEXT, initial, more, "K"))
    return multiply(INSERTS, edit)


_TURNS = {(i, g, t): turn_matrix(i, g, t) for i in ("s", "u", "a", "") for g in (False, True) for t in (False, True)}


def power(x: Matrix, n: int) -> Matrix:
    """`x` n times in a row."""
    out = UNIT
    while n:
        out = multiply(out, x) if n & 1 else out
        x, n = multiply(x, x) if n > 1 else x, n >> 1
    return out


class Product:
    """Matrices multiplied as they come, as a tree: equally long runs meet, so audits are joined a logarithmic number of times."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, Matrix]] = []

    def add(self, x: Matrix) -> None:
        size = 1
        while self.runs and self.runs[-1][0] == size:
            before, held = self.runs.pop()
            size, x = size + before, multiply(held, x)
        self.runs.append((size, x))

    def value(self) -> Matrix:
        out = None
        for _, x in reversed(self.runs):
            out = x if out is None else multiply(x, out)
        return UNIT if out is None else out


def cheapest(x: Matrix) -> tuple[int, str]:
    """The cheapest way through all turns of `x` that ends where the grammar may."""
    whole = multiply(x, INSERTS)
    return min(whole[j] for j in ENDS if whole[j] is not None)


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[str]:
    """`role:text` of each turn that the edits of `audit` leave, for rows (role, text) in order."""
    place = 0  # state of the grammar
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s":
            place = 1
        else:
            place = 3 if place == 2 else 2
        yield f"{role if letter == 'K' else 'assistant' if place == 3 else 'user'}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn` chooses.

    A null is one space, in the key as well; conv_id and turn stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), fault.alias("_f")
    )
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("_f <> 0").withColumns({"text": text, "role": F.when(F.col("_f") == 4, "user").otherwise(F.col("role"))})
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_f") == 3, 2).otherwise(1)))
    return rows.withColumn("_copy", times).select("conv_id", "turn", "role", "text")


RUN = (
    "conv_id long, part int, edge boolean, rows long, blank long, duplicate long, truncated long, illegal long, turns long, "
    "low long, high long, first_role string, last_role string, costs array<long>, audits array<string>"
)
COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


def ordered_turns(rows: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, text) with `m`, their number, and `fresh`: its role and text aren't those of an earlier turn.

    Nulls of turn come first; turns of one number are ordered by role and text, so equal rows lie
    together. Where a role and text first stand comes from a minimum, not from a window, so a text
    that a long conversation repeats is no task's group.
    """
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    units = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("m"))
    units = units.withColumns({"digest": digest, "_at": F.struct(F.col("turn").isNotNull().alias("known"), "turn")})
    firsts = units.groupBy("conv_id", "digest").agg(F.min("_at").alias("_first")).withColumnsRenamed({"conv_id": "_conv", "digest": "_digest"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    return units.join(firsts, same).select("conv_id", "turn", "role", "text", "m", F.col("_at").eqNullSafe(F.col("_first")).alias("fresh"))


def _sorted_by_range(units: DataFrame) -> DataFrame:
    """Turns dealt by range, so that a very long conversation lies in several tasks, in order."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    # long texts don't travel to the driver for the borders; equal beginnings stay together
    return units.repartitionByRange(*order, "role", F.substring("text", 1, 16)).sortWithinPartitions(*order, "role", "text")


def turn_runs(units: DataFrame) -> DataFrame:
    """Rows of RUN: the product of each conversation's turns in each task, with the counts that add up along it."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, key, first = TaskContext.get().partitionId(), None, None, True
        done: list[tuple] = []

        def close(last: bool) -> None:
            x = now["product"].value()
            done.append((
                key, part, now["edge"] or last, *[now[c] for c in COUNTS], now["low"], now["high"], now["first_role"], now["last_role"],
                [None if p is None else p[0] for p in x], [None if p is None else p[1] for p in x],
            ))

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(done, columns=[c.split()[0] for c in RUN.split(", ")])
            for c in ("conv_id", "low", "high"):
                out[c] = out[c].astype("Int64")
            done.clear()
            return out

        for pdf in batches:
            for conv, turn, role, text, m, fresh in zip(
                pdf["conv_id"].astype("Int64").tolist(), pdf["turn"].astype("Int64").tolist(), pdf["role"].tolist(), pdf["text"].tolist(), pdf["m"].tolist(), pdf["fresh"].tolist()
            ):
                conv, turn = (None if v is pd.NA else v for v in (conv, turn))
                if now is None or conv != key:
                    if now is not None:
                        close(False)
                    key, now = conv, dict.fromkeys(COUNTS, 0) | {"product": Product(), "edge": first, "low": turn, "high": turn, "first_role": role[:1], "last_role": None}
                    first = False
                empty = not _SOLID.search(text)
                # of equal rows the first may be fresh, the others repeat it
                again = 0 if empty else m - fresh
                kept = 0 if empty else m - again
                open_end = bool(kept) and text.rstrip(" \t\n\v\f\r")[-1:] not in (".", "!", "?")
                initial = role[:1] if role[:1] in NEXT else ""
                if kept:
                    now["product"].add(_TURNS[initial, False, open_end])
                if gone := m - kept:
                    now["product"].add(power(_TURNS[initial, True, False], gone))
                now["rows"] += m
                now["blank"] += m * empty
                now["duplicate"] += again
                now["truncated"] += open_end
                if now["last_role"] is not None:
                    now["illegal"] += now["last_role"] + role[:1] not in LEGAL
                now["illegal"] += (m - 1) * (role[:1] * 2 not in LEGAL)
                if turn is not None and (now["turns"] == 0 or turn != now["high"]):
                    now["turns"] += 1
                now["low"] = turn if now["low"] is None else now["low"]
                now["high"], now["last_role"] = turn if turn is not None else now["high"], role[:1]
            if len(done) >= 2000:
                yield frame()
        if now is not None:
            close(True)
        if done:
            yield frame()

    return _sorted_by_range(units).mapInPandas(lean(each), RUN)


def _whole(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def join_runs(a: dict, b: dict) -> dict:
    """The run of what `a` covers followed by what `b` covers."""
    out = {c: a[c] + b[c] for c in COUNTS}
    out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["low"] = a["low"] if a["low"] is not None else b["low"]
    out["high"] = b["high"] if b["high"] is not None else a["high"]
    return out | {"first_role": a["first_role"], "last_role": b["last_role"], "matrix": multiply(a["matrix"], b["matrix"])}


def whole_runs(runs: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row of RUN for each conversation: runs at a task's border meet `fan_in` at a time, level by level.

    Only a task's first and last conversation can go on in another, so there are at most two such
    runs a task, and none of the tree's tasks gets more than `fan_in` of one conversation.
    """
    runs = cut(runs)
    tree, done = runs.where("edge"), [runs.where("not edge")]
    widest = (tree.agg(F.max("part")).first()[0] or 0) + 1

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        held = None
        for r in pdf.itertuples(index=False):
            run = {c: int(getattr(r, c)) for c in COUNTS} | {"low": _whole(r.low), "high": _whole(r.high), "first_role": r.first_role, "last_role": r.last_role}
            run["matrix"] = [None if w is None else (int(c), w) for c, w in zip(r.costs, r.audits)]
            held = run if held is None else join_runs(held, run)
        out = pdf.iloc[:1].copy()
        for c in (*COUNTS, "low", "high", "first_role", "last_role"):
            out[c] = pd.Series([held[c]], index=out.index, dtype="Int64" if c in ("low", "high") else None)
        out["costs"] = pd.Series([[None if p is None else p[0] for p in held["matrix"]]], index=out.index)
        out["audits"] = pd.Series([[None if p is None else p[1] for p in held["matrix"]]], index=out.index)
        out["conv_id"], out["part"] = out["conv_id"].astype("Int64"), out["part"] // fan_in
        return out

    while widest > 1:
        tree = cut(tree.groupBy("conv_id", F.floor(F.col("part") / fan_in).alias("_g")).applyInPandas(meet, RUN))
        widest = -(-widest // fan_in)
    return done[0].unionByName(tree)


def audits(runs: DataFrame) -> DataFrame:
    """`runs` of whole conversations with cost and audit, without matrices."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = [cheapest([None if w is None else (int(c), w) for c, w in zip(cs, ws)]) for cs, ws in zip(pdf["costs"], pdf["audits"])]
            out = pdf[["conv_id", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]].copy()
            for c in ("conv_id", "low", "high"):
                out[c] = out[c].astype("Int64")
            yield out.assign(cost=[b[0] for b in best], audit=[b[1] for b in best])

    counts = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"
    return runs.mapInPandas(lean(each), f"conv_id long, {counts}, cost long, audit string")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (conv_id, repaired_sha256): the hash of the newline-joined repaired turns, for `found(conv_id, audit)`.

    A conversation's audit comes before its turns in one sorted stream, and the hash takes them
    one by one: a hash is sequential, so a conversation is one task's, but never in its memory.
    """
    turns = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    first = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = first.unionByName(turns).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "text"
    )

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream() -> Iterator[tuple]:
            for pdf in batches:
                yield from zip(pdf["conv_id"].astype("Int64").tolist(), pdf["kind"].tolist(), pdf["role"].tolist(), pdf["text"].tolist())

        rest = stream()
        done: list[tuple] = []
        head = next(rest, None)
        while head is not None:
            conv, audit = head[0], head[3]
            head = None

            def own() -> Iterator[tuple[str, str]]:
                nonlocal head
                for r in rest:
                    if r[1] == 0:
                        head = r
                        return
                    yield r[2], r[3]

            left = own()
            h, begun = hashlib.sha256(), False
            for line in repaired(left, audit):
                h.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                begun = True
            for _ in left:  # an audit has a letter for each turn, so only the next head is read here
                raise ValueError(f"conversation {conv}: more turns than edits")
            done.append((conv, h.hexdigest()))
            if len(done) >= 2000:
                yield pd.DataFrame(done, columns=["conv_id", "sha"]).astype({"conv_id": "Int64"}).rename(columns={"sha": "repaired_sha256"})
                done = []
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})

    return both.mapInPandas(lean(each), "conv_id long, repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """For each conv_id of `rows(conv_id, turn, role, text)`: what is wrong with it, the cheapest edits, and what they leave.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows without conv_id are one conversation; a null role or text is one space, a null turn
    comes first; turns of one number are ordered by role and text, so repeated rows
    lie together; an empty text is blank. Other columns are not read; an empty table gives an
    empty one. An audit is one value, so a conversation has at most about 2 billion edits.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = cut(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text")))
    found = cut(audits(whole_runs(turn_runs(ordered_turns(rows)))))
    hashes = repaired_turns(rows, found).withColumnRenamed("conv_id", "_conv")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def op12_repair(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair_conversations(damaged(given)).withColumnRenamed("conv_id", "_conv")
    every = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: crc32 by its definition, bit by bit; the cheapest way to each state after each turn.
OP12_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 20 AS f
  FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM summed, LATERAL (SELECT unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    left(role, 1) AS initial FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM numbered
), ins(a, b, cost, audit, lines) AS (VALUES
  (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
  (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
), moves(a, b, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
edits AS (
  SELECT conv_id, i, s.a, s.a AS b, 3 AS cost, 'D' AS audit, []::VARCHAR[] AS lines FROM judged, (SELECT unnest(range(4)) AS a) s
  UNION ALL
  SELECT conv_id, i, a, b, (fault = 'truncated')::INT, 'K', [role || ':' || text] FROM judged JOIN moves USING (initial) WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, i, a, b, 2 + (fault = 'truncated')::INT, 'R', [CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM judged, moves m WHERE fault IN ('', 'truncated') AND m.initial <> 's'
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, ins.b AS state, ins.cost, ins.audit, ins.lines FROM damaged, ins WHERE ins.a = 0
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT p.conv_id, p.i + 1 AS i, n.b AS state, p.cost + e.cost + n.cost AS cost, p.audit || e.audit || n.audit AS audit,
      list_concat(list_concat(p.lines, e.lines), n.lines) AS lines,
      row_number() OVER (PARTITION BY p.conv_id, n.b ORDER BY p.cost + e.cost + n.cost, p.audit || e.audit || n.audit) AS r
    FROM best p JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.a = p.state JOIN ins n ON n.a = e.b
  ) WHERE r = 1
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), chosen AS (
  SELECT b.conv_id, b.cost, b.audit, b.lines FROM best b JOIN counted c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n
  WHERE b.state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost, b.audit) = 1
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN chosen d ON a.conv_id IS NOT DISTINCT FROM d.conv_id
"""
