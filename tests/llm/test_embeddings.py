import math

import numpy as np

from quillstone.llm import embeddings


def brute(rows: list[tuple], threshold=0.93) -> dict:
    """rows of (vec_id, embedding, label) with distinct ids -> vec_id: (n_links, component)."""
    def sound(r):
        e = r[1]
        return r[2] is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    links = {r[0]: set() for r in rows}
    good = [(r[0], np.array(r[1], float), r[2]) for r in rows if sound(r)]
    for i, (a, x, l) in enumerate(good):
        for b, y, m in good[i + 1 :]:
            if l == m and len(x) == len(y) and float(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out, seen = {}, {}
    for start in sorted(links):
        todo = [start]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen[k] = start
                todo += links[k]
    for k in links:
        out[k] = (len(links[k]), seen[k])
    return out


def table(df) -> dict:
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = embeddings.op2_embedding_dedup(spark, d).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_many_cells_and_blocks_lose_no_link(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 16))
    rows = []
    for i in range(700):
        x = centres[i % 12] + draw.normal(size=16) * (0.12 if i % 2 else 0.5)
        rows.append((i, x.tolist(), i % 3))
    rows += [(700 + i, rows[5][1], rows[5][2]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    for block in (4096, 20):
        assert table(embeddings.embedding_groups(df, block=block)) == want
    assert max(n for n, _ in want.values()) > 40


def test_chains_across_blocks(spark):
    """Links that only a row of another block knows of: one cell, blocks of a few rows."""
    for seed in range(2):
        ids = np.random.default_rng(seed).permutation(60).tolist()
        rows = [(ids[i], [math.cos(0.3 * (i % 15)) if j == 2 * (i // 15) else math.sin(0.3 * (i % 15)) if j == 2 * (i // 15) + 1 else 0.0 for j in range(8)], 1) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        assert table(embeddings.embedding_groups(df, block=6, most_cells=1)) == brute(rows)


def test_crowded_cells_are_cut_again(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(30, 12))
    rows = [(i, (centres[i % 30] + draw.normal(size=12) * (0.15 if i % 2 else 0.6)).tolist(), 1) for i in range(600)]
    # one direction, different lengths: no centroid can part them
    rows += [(600 + i, [float(i + 1)] * 12, 2) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert table(embeddings.embedding_groups(df, block=8, most_cells=3)) == brute(rows)
    classes = df.selectExpr("label", "12 AS dim", "vec_id AS id", "1L AS m", "embedding").where("label = 1")
    x = embeddings.unit(np.array([r[1] for r in rows[:600]]))
    whole = embeddings.cell_rows(classes, {12: embeddings.spherical_kmeans(x, 3)}, 0.93)
    parts = embeddings.split_cells(whole, 0.93, 8, 200, 3)
    assert parts.where("home").count() == 600 and parts.where("home").select("id").distinct().count() == 600
    homes = lambda df: max(r["count"] for r in df.where("home").groupBy("cell").count().collect())
    assert homes(parts) < homes(whole) / 3
    assert embeddings.split_cells(whole.limit(0), 0.93, 8, 200, 3).count() == 0


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [2.0, 0.1], 1), (13, [-1.0, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    assert table(embeddings.embedding_groups(df)) == brute(rows)
    assert embeddings.embedding_groups(df.limit(0)).count() == 0
    twice = embeddings.embedding_groups(spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int"))
    assert sorted((r.vec_id is None, r.n_links, r.component_id) for r in twice.collect()) == [(False, 2, 1), (False, 2, 1), (True, 2, 1)]
