from collections import Counter
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from quillstone.llm import decontaminate as dc

TOKEN = re.compile(r"[^\W_]+")


def grams(words, k=5) -> Counter:
    k = min(k, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else Counter()


def similarity(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(docs, items) -> dict:
    """(doc, item): the best similarity of any window of the item's size, from 0.8 up."""
    out = {}
    sized = [(i, w, grams(w)) for i, t in items if (w := TOKEN.findall((t or "").lower()))]
    for d, text in docs:
        w = TOKEN.findall((text or "").lower())
        known = set(w)
        for i, want, g in sized:
            if len(known.intersection(want)) < 0.5 * len(set(want)):
                continue
            n = len(want)
            best = max((similarity(grams(w[s : s + n]), g) for s in range(max(1, len(w) - n + 1))), default=0.0) if w else 0.0
            if best >= 0.8 - 1e-12:
                out[d, i] = best
    return out


def test_query_holds_all_that_brute_force_finds(spark):
    d = "/root/testdata/sf0.01"
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect() if len(r.text or "") < 6000]
    want = brute(docs, items)
    keep = {k for k, _ in docs}
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.op9_decontamination(spark, d).collect() if r.doc_id in keep}
    assert want and set(got) == set(want)
    assert got == pytest.approx(want)


def test_changed_passages(spark):
    draw = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(900)]
    items = [(i, " ".join(draw.choice(vocabulary, 60))) for i in range(8)]
    docs = []
    for k in range(120):
        words = items[k % 8][1].split()
        for at in draw.choice(60, k % 4, replace=False):
            words[at] = "changed"
        before = draw.choice(vocabulary, int(draw.integers(0, 90))).tolist()
        docs.append((k, " ".join([*before, *words, *draw.choice(vocabulary, 20).tolist()])))
    want = brute(docs, items)
    frames = [spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contamination(*frames).collect()}
    assert len(want) >= 60 and set(got) <= set(want)
    # a fingerprint search misses pairs only where the fingerprints lie farther apart than the radius
    missed = [want[k] for k in want if k not in got]
    assert len(missed) <= 0.02 * len(want)
    left = {r.doc_id for r in dc.decontaminate(*frames).collect()}
    assert left == {k for k, _ in docs} - {d for d, _ in got}


def test_multi_index_search_is_complete(spark):
    draw = np.random.default_rng(8)
    items = [(i, 50, int(draw.integers(-(1 << 62), 1 << 62))) for i in range(40)]
    found = []
    for k in range(600):
        fp = items[k % 40][2]
        for bit in draw.choice(64, int(draw.integers(0, 26)), replace=False):
            fp ^= int(np.uint64(1 << int(bit)).view(np.int64))
        found.append((k, 50, fp))
    got = {tuple(r) for r in dc.hamming_pairs(spark.createDataFrame(found, "content long, size int, fp long"), spark.createDataFrame(items, "item_id long, size int, fp long")).collect()}
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert got == {(k, i) for k, _, a in found for i, _, b in items if apart(a, b) <= dc.RADIUS}


def test_edges(spark):
    schema = "doc_id long, text string, item_id string, size string"
    item = "one two three four five six seven eight"
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, f"Say: {item.upper()}!", None, None), (None, item, None, None), (None, "clean", None, None), (4, "one two three", None, None), (5, "filler " * 20_000 + item, None, None), (3, "again", None, None), (6, "hello", None, None)]
    docs = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([(9, item), (7, item), (8, None), (10, ""), (11, "one two three"), (12, "hello")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in dc.contamination(docs, items).collect()}
    assert got[3, 7] == (1.0, 1) and got[5, 7] == (1.0, 20_000) and got[4, 11] == (1.0, 0) and got[6, 12] == (1.0, 0)
    assert (None, 7) in got and not any(i in (8, 9, 10) for _, i in got) and not {1, 2} & {d for d, _ in got}
    assert sorted(((r.doc_id or 0), r.text or "") for r in dc.decontaminate(docs, items).collect()) == [(0, "clean"), (1, ""), (2, ""), (3, "again")]
    none = items.limit(0)
    assert dc.contamination(docs, none).count() == 0 and dc.decontaminate(docs, none).count() == len(rows)
    assert dc.contamination(docs.limit(0), items).count() == 0


def test_clean_rows_stay_beside_contaminated_ones_of_their_doc_id(spark):
    item = "one two three four five six seven eight"
    rows = [(None, item, "a"), (None, "clean", "b"), (None, None, "c"), (3, f"Say: {item}!", "d"), (3, "again", "e"), (3, "again", "f"), (4, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.source for r in dc.decontaminate(docs, items).collect()) == ["b", "c", "e", "f", "g"]
    assert dc.decontaminate(docs, items.limit(0)).count() == len(rows)


def test_the_pipeline_stage_keeps_clean_rows(spark, tmp_path):
    item = "one two three four five six seven eight"
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, "clean"), (3, item), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert sorted(r.text for r in cp.drop_leaks(spark, docs, str(tmp_path)).collect()) == ["again", "clean"]


def test_clashing_column_names_stay(spark):
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, item, "a"), (2, "clean", "b")], "doc_id long, text string, _hit string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    for name in ("_hit", "_own key", "key", "row"):
        assert [tuple(r) for r in dc.decontaminate(docs.withColumnRenamed("_hit", name), items).collect()] == [(2, "clean", "b")]
