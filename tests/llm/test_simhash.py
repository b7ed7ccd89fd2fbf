import re

import numpy as np
import xxhash

from quillstone.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text) -> int:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps: list[tuple], radius=4) -> dict:
    ids, values = [k for k, _ in fps], np.array([v for _, v in fps], np.uint64)
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, k in enumerate(ids):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius)
        for j in near.tolist():
            a, b = find(k), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = groups(docs)
    got = simhash.op6_simhash(spark, d).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in docs}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(docs)


def test_links_of_crowded_buckets(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(25):
            flip = 0
            for bit in draw.choice(64, draw.integers(1, 6), replace=False):
                flip |= 1 << int(bit)
            values.add(b ^ flip)
    values |= {k << 40 for k in range(300)}
    rows = sorted(values)
    want = groups([(v, v) for v in rows])
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in rows], "fp long")
    for block in (8192, 16):
        edges = simhash.fingerprint_links(frame, block=block).collect()
        root = {v: v for v in rows}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for e in edges:
            a, b = (int(np.int64(x).view(np.uint64)) for x in (e.a, e.b))
            assert (a ^ b).bit_count() <= 64
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert {v: find(v) for v in rows} == want


def test_within_radius_counts_every_distance():
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 1 << 63, 130, dtype=np.uint64)
    fps[60:90] = fps[0] ^ (np.uint64(1) << np.arange(30, dtype=np.uint64))
    fps[100] = fps[0] ^ np.uint64(0b11111)
    fps[101] = fps[0] ^ np.uint64(0b1111)
    planes = simhash.planes_of(fps)
    words = np.repeat([0, 1, 2], 130)
    rows = np.tile(np.arange(130), 3)
    mask = np.full(390, ~np.uint64(0))
    mask[words == 2] = np.uint64(0b11)
    for radius in (0, 1, 3, 4, 7):
        i, j = simhash.within_radius(fps, planes, rows, words, mask, radius)
        want = {(a, b) for a in range(130) for b in range(130) if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_edges(spark):
    schema = "doc_id long, text string, component_id string"
    assert simhash.simhash_groups(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(7, "Same Words here", "x"), (3, "same words HERE", None), (5, None, None), (6, "", None), (None, " \t\n", None), (9, long, None), (9, long, None), (2, long + " tail", None), (None, "lone words of their own kind", None)]
    docs = spark.createDataFrame(rows, schema)
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.fp, r.component_id))
    assert by[7][0] == by[3][0] and by[7][0][1] == 3
    assert by[5] == [(0, 5)] and by[6] == [(0, 5)] and (0, 5) in by[None]
    assert by[9][0] == by[9][1] and by[9][0][1] == 2
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 2), (False, 3), (False, 5), (True, 0)]
    assert set(kept[0].asDict()) == {"doc_id", "text", "component_id"}


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (4, "a b c d e f")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in kept] == [(1, "a b c d e f")]


def test_groups_without_doc_id_keep_a_row_each(spark):
    texts = [f"{w} one {w} two {w} three {w} four {w}" for w in ("red", "green", "blue", "gold")]
    rows = [(None, texts[0], "a"), (None, texts[0], "b"), (None, texts[1], "c"), (None, texts[2], "d"), (8, texts[2], "e"), (8, texts[3], "f")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.text, r.doc_id or 0) for r in kept) == sorted([(texts[0], 0), (texts[1], 0), (texts[2], 8), (texts[3], 8)])


def test_rows_are_judged_one_by_one(spark):
    words = {w: " ".join(f"{w}{k}" for k in range(9)) for w in "abcd"}
    rows = [(3, "a"), (7, "a"), (7, "b"), (9, "b"), (9, "c"), (9, "d")]
    docs = spark.createDataFrame([(k, words[w], w) for k, w in rows], "doc_id long, text string, _kept string")
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id, r._kept) for r in kept) == [(3, "a"), (7, "b"), (9, "c"), (9, "d")]
    for name in ("_hash", "fp", "row", "hash", "n", "root", "kept"):
        again = simhash.keep_one(docs.withColumnRenamed("_kept", name))
        assert again.columns == ["doc_id", "text", name] and again.count() == 4


def test_components_of_a_hub(spark):
    from quillstone.llm.common import components

    edges = [(k, 0) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(40)] + [(9000, 2999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(3000)) and got[9000] == 0 and all(got[5000 + k] == 5000 for k in range(41))
