import random
import re

import pytest

from quillstone.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict, weights=(1, 2, 3), cap=3) -> dict:
    """Water filling, one source after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in full]
        if not free:
            return full
        rate = (total - sum(full.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rate > cap * sizes[s] + 1e-9]
        if not over:
            return full | {s: weight[s] * rate for s in free}
        full |= {s: float(cap * sizes[s]) for s in over}


def test_query_against_plain_python(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in mixing.op1_mixing(spark, d).collect()}
    assert set(got) == set(docs)
    sizes, taken = {}, {}
    for k, r in docs.items():
        n = len(WORD.findall(r.text or ""))
        assert got[k]["size"] == n and got[k]["taken"] <= 3 * n and (n == 0 or got[k]["taken"] % n == 0)
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + got[k]["taken"]
    want = targets(sizes)
    for k, r in docs.items():
        assert got[k]["source_size"] == sizes[r.source]
        assert got[k]["target"] == pytest.approx(want[r.source], rel=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 60)
    again = {r.doc_id: r.taken for r in mixing.op1_mixing(spark, d).collect()}
    assert again == {k: r["taken"] for k, r in got.items()}


def test_targets_stop_at_three_times_and_the_excess_goes_on(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, None: 100, "e": 0}
    rows = [(s, n, 1) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long, m long")).collect()}
    want = targets(sizes)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_pivotal_keeps_the_sum_and_leaves_one_small_unit_open():
    draw = random.Random(3)
    sizes = [20_000, *[draw.randint(5, 400) for _ in range(400)]]  # enough words to make up for the large one
    for seed in range(50):
        rows = [[f"k{i}", s, 1, 0.37, True] for i, s in enumerate(sizes)]
        all_rows, before = list(rows), sum(s * 1.37 for s in sizes)
        mixing._pivotal(rows, seed)
        left = [r for r in all_rows if r[4]]
        assert sum(r[1] * (r[2] + r[3]) for r in all_rows) == pytest.approx(before)
        assert len(left) <= 1 and all(r[1] <= 400 for r in left)
        assert all(r[2] in (1, 2) and 0 <= r[3] < 1 for r in all_rows)


def test_many_leaves_meet_in_a_tree(spark):
    rows = [(i, "one two three " * (1 + i % 7), "hot" if i % 3 else "cold") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs, chunk=8, fan_in=4).collect()
    assert len(mixed) == 900
    for source in ("hot", "cold"):
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0].target) <= 21
    assert mixing.take(mixing.mix_sources(docs, chunk=8, fan_in=4)).count() == sum(r["copies"] for r in mixed)


def test_edges(spark):
    schema = "doc_id long, text string, source string, size string, lang string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "x", None), (1, None, None, "x", None), (2, "", "s", "x", "en"), (None, "a b c", "s", None, None), (3, "a " * 5000, "t", None, "de"), (4, "  \x0b", "", None, None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6
    by = {r.text: r for r in got}
    assert by[None]["size"] == 0 and by[""]["size"] == 0 and by["a b c"]["size"] == 3 and by["a " * 5000]["size"] == 5000
    assert by["  \x0b"]["size"] == 1
    assert all(r["copies"] <= 3 and r.source_size >= r["size"] for r in got)
    assert sum(r.lang == "en" for r in got) == 1


def _words(n):
    return " ".join(["w"] * n)


def test_repeated_rows_are_rounded_one_by_one(spark):
    # source a is one row a hundred times; source b has single rows
    rows = [(7, _words(10), "a")] * 100 + [(100 + k, _words(10), "b") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for again in (docs, docs.repartition(7)):
        mixed = mixing.mix_sources(again).collect()
        assert len(mixed) == 110
        for source in "ab":
            own = [r for r in mixed if r.source == source]
            assert abs(sum(r["copies"] * r["size"] for r in own) - own[0].target) <= 10
            assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1


def test_rows_without_doc_id_are_rounded_one_by_one(spark):
    rows = [(None, _words(10), "a")] * 300 + [(k, _words(5 + k), "a") for k in range(20)] + [(1000 + k, _words(7), "b") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    first = mixing.mix_sources(docs).collect()
    for source, near in (("a", 24), ("b", 7)):
        own = [r for r in first if r.source == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0].target) <= near
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source, r["copies"])
    assert sorted(map(key, first)) == sorted(map(key, mixing.mix_sources(docs.repartition(3)).collect()))


def test_clashing_names(spark):
    rows = [(k, _words(3), "s", "x") for k in range(9)] + [(0, _words(3), "s", "x")]
    for name in ("_doc_id", "_size", "unit", "row", "part", "m", "up", "h", "more", "`a.b`"):
        mixed = mixing.mix_sources(spark.createDataFrame(rows, f"doc_id long, text string, source string, {name} string"))
        assert mixed.columns == ["doc_id", "text", "source", name.strip("`"), "size", "source_size", "target", "copies"]
        if name in ("_doc_id", "unit", "`a.b`"):
            assert mixed.count() == 10 and mixing.take(mixed).columns == ["doc_id", "text", "source", name.strip("`")]
