import hashlib
import random
import re
import zlib

import pandas as pd

from quillstone.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def _best(rows):
    """Cheapest, ASCII-least (cost, audit, lines) over every order of edits, state by state."""
    legal = re.compile(r"(s?(ua)+)?")
    seen, found = {}, {}
    todo = [(0, 0, "", "", ())]  # cost, rows read, initials, audit, lines
    while todo:
        todo.sort(key=lambda x: (x[0], x[3]))
        cost, i, initials, audit, lines = todo.pop(0)
        tail = initials[-1:] or "-"
        if seen.setdefault((i, tail), (cost, audit)) < (cost, audit) and seen[i, tail][0] < cost:
            continue
        if i == len(rows) and legal.fullmatch(initials):
            found.setdefault(cost, []).append((audit, lines))
        if found and cost > min(found):
            break
        ok = lambda c: (tail, c) in {("-", "s"), ("-", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
        for c, name in (("u", "user"), ("a", "assistant")):
            if ok(c) and len(initials) < 2 * len(rows) + 4:
                todo.append((cost + 2, i, initials + c, audit + "I", (*lines, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            todo.append((cost + 3, i + 1, initials, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if ok(role[:1]):
                    todo.append((cost + more, i + 1, initials + role[:1], audit + "K", (*lines, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if ok(c):
                        todo.append((cost + 2 + more, i + 1, initials + c, audit + "R", (*lines, f"{name}:{text}")))
    audit, lines = min(found[min(found)])
    return min(found), audit, "\n".join(lines)


def _plain(rows):
    """The contract for rows (conv_id, turn, role, text), conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            judged.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        cost, audit, lines = _best(judged)
        turns = {t for t, _, _ in mine if t is not None}
        count = lambda f: sum(x[2] == f for x in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def _got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_against_every_edit(spark):
    draw = random.Random(3)
    texts = ["Yes.", "No", "", None, "So?\n", "a b", "é!", "Yes.", " \t"]
    rows = [(draw.choice([None, *range(60)]), draw.choice([None, *range(6)]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), draw.choice(texts)) for _ in range(240)]
    few = {c for c in {r[0] for r in rows} if sum(r[0] == c for r in rows) <= 6}
    rows = [r for r in rows if r[0] in few]
    assert _got(repair.repair_conversations(spark.createDataFrame(rows, SCHEMA))) == _plain(rows)


def test_conversation_over_many_tasks(spark):
    rows = [(k % 3, k, ("user", "assistant", "user")[k % 3 - k // 40 % 2], f"{k % 50}{'.' if k % 7 else ''}") for k in range(1500)] + [(9, 1, "user", "x.")]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = repair.turn_runs(repair.ordered_turns(df)).toPandas()
        assert runs["part"].nunique() > 10 and len(runs) > 20
        many = _got(repair.repair_conversations(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        assert many == _got(repair.repair_conversations(df))  # one task multiplies all turns in a row
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(many) == 4 and many[0][2] == 500 - len({r[2:] for r in rows if r[0] == 0})


def test_product_is_associative():
    draw = random.Random(1)
    turns = [repair.turn_matrix(draw.choice(["s", "u", "a", ""]), draw.random() < 0.2, draw.random() < 0.3) for _ in range(40)]
    left = repair.UNIT
    for t in turns:
        left = repair.multiply(left, t)
    right = repair.UNIT
    for t in reversed(turns):
        right = repair.multiply(t, right)
    tree = repair.Product()
    for t in turns:
        tree.add(t)
    assert left == right == tree.value()
    assert repair.power(turns[0], 11) == repair.multiply(repair.power(turns[0], 4), repair.power(turns[0], 7))


def test_edges(spark):
    got = _got(repair.repair_conversations(spark.createDataFrame([], SCHEMA)))
    assert got == {}
    rows = [(1, 0, "user", "again.")] * 5000 + [(2, 1, "assistant", "x" * 3_000_000)]
    got = _got(repair.repair_conversations(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as m", "2 as fresh", "3 as part")))
    assert got[1][2] == 4999 and got[1][5] == 4999 * 3 + 2 and got[1][6] == "K" + "D" * 4999 + "I"
    assert got[2][5:7] == (3, "D")  # an added user turn and the cut-off text cost as much, but D comes first
    df = spark.createDataFrame([(3, 7, "user", None), (3, None, None, "x.")], SCHEMA)
    assert _got(repair.repair_conversations(df))[3][:5] == (0, 1, 0, 0, 1)


def test_query_on_damaged_rows(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2] if t else None, None if (c + t) % 11 == 0 else f"Text {c} {t}.") for c in range(40) for t in range(3)] + [(None, None, "user", "a.")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    after = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        after += [(c, t, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    expect = {c: (0,) * 6 + ("", EMPTY) for c in {r[0] for r in rows}} | _plain(after)
    got = _got(repair.op12_repair(spark, str(tmp_path)))
    assert got == expect and pd.Series([v[5] for v in got.values()]).sum() > 0
