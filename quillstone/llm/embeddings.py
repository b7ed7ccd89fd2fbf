"""Embedding near-duplicates: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import components, cut
from quillstone.llm.simhash import forest


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Unit centroids of unit vectors; cells that empty out keep their centroid."""
    draw = np.random.default_rng(seed)
    centroids = sample[draw.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        home = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1)
        centroids[size > 1e-12] = (sums / np.maximum(size, 1e-12)[:, None])[size > 1e-12]
    return centroids


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that can link: a label, and a vector that is finite, whole and not zero."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & sound & F.exists(e, lambda x: x != 0))


CELL = ["label", "dim", "cell"]
ROWS = "label int, dim int, cell string, home boolean, id long, m long, embedding array<double>"


def chord_of(threshold: float) -> float:
    """The distance of unit vectors whose cosine is the threshold."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9)


def visits(x: np.ndarray, c: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): the cells of centroids c that hold unit vectors x or may hold a vector within the chord of them.

    A vector y of another cell is at least as near that cell's centroid as its own, h, is to x,
    so |x - y| is at least x's distance from the plane between the two; cells beyond the chord
    can hold no partner. No link is lost at a cell's border.
    """
    s = x @ c.T
    home = np.argmax(s, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[home]
    gap = (s[np.arange(len(s)), home][:, None] - s) / np.where(apart > 0, apart, 1)
    row, cell = np.nonzero(gap <= chord)
    return row, cell, cell == home[row]


def cell_rows(classes: DataFrame, centroids: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Rows (label, dim, cell, home, id, m, embedding): each class at home, and as a visitor in
    every other cell that may hold a vector within the threshold."""
    chord = chord_of(threshold)
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = unit(np.stack(part["embedding"].to_numpy()).astype(np.float64))
                row, cell, home = visits(x, shared.value[dim], chord)
                out = part.iloc[row][["label", "dim", "id", "m", "embedding"]].reset_index(drop=True)
                yield out.assign(cell=cell.astype(str), home=home)[["label", "dim", "cell", "home", "id", "m", "embedding"]]

    return classes.mapInPandas(each, ROWS)


def split_cells(cells: DataFrame, threshold: float, block: int, sample: int, most_cells: int) -> DataFrame:
    """`cells` with every one of more than four blocks of home rows cut by centroids of its own, until none is left or they
    no longer shrink; what then is still crowded is compared in blocks.

    A cell's centroids come from about `sample` of its home rows, by a hash of the id, one for each block, at most `most_cells`. Its
    rows, visitors too, meet them a slice of about a block at a time. A row is at home where it was
    and its nearest centroid says so, and visits the other parts within reach, so no link is lost.
    """
    chord, largest, level = chord_of(threshold), float("inf"), 0

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(pdf.sort_values("id")["embedding"].to_numpy()).astype(np.float64))
        c = spherical_kmeans(x, int(min(pdf["k"].iloc[0], len(x))))
        return pdf.iloc[:1][CELL].assign(centroids=[c.tolist()])

    def part(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:  # a cell of which no row was drawn stays whole
            return rows[[*CELL, "home", "id", "m", "embedding"]]
        x = unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        row, cell, home = visits(x, np.stack([np.asarray(c, np.float64) for c in own["centroids"].iloc[0]]), chord)
        out = rows.iloc[row][[*CELL, "home", "id", "m", "embedding"]].reset_index(drop=True)
        return out.assign(cell=out["cell"] + "/" + cell.astype(str), home=out["home"].to_numpy(bool) & home)

    while True:
        size = cells.groupBy(*CELL).agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")).where(F.col("homes") > 4 * block)
        size = size.withColumns({"k": F.least(F.ceil(F.col("homes") / block), F.lit(most_cells)).cast("int"), "slices": F.ceil(F.col("rows") / block).cast("int")})
        size = cut(size)
        now = size.agg(F.max("homes")).first()[0]
        if now is None or now > 0.9 * largest:
            return cells
        largest, level = now, level + 1
        inside = cells.join(size, CELL)
        drawn = inside.where(F.col("home") & (F.pmod(F.xxhash64(F.lit(level), "id"), "homes") < sample))
        own = drawn.select(*CELL, "id", "embedding", "k").groupBy(*CELL).applyInPandas(fit, "label int, dim int, cell string, centroids array<array<double>>")
        own = cut(own).join(size, CELL).select(*CELL, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "centroids")
        met = inside.withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int")).select(*CELL, "slice", "home", "id", "m", "embedding")
        parts = met.groupBy(*CELL, "slice").cogroup(own.groupBy(*CELL, "slice")).applyInPandas(part, ROWS)
        cells = cut(cells.join(size.select(*CELL), CELL, "left_anti").select(*parts.columns).unionByName(parts))


def cosine_links(cells: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows (id, n, root): for a class and a block, the vectors linked there (0 where it is only told) and one of its component.

    All rows of a cell, visitors too, are compared with its home rows, `block` by `block`; cells
    larger than that are cut by a hash of the id, so that no task has more than two blocks.
    A class's rows in the blocks of its own cell include itself.
    """
    size = cells.groupBy("label", "dim", "cell").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"))
    size = size.select("label", "dim", "cell", F.ceil(F.col("rows") / block).cast("int").alias("qs"), F.greatest(F.ceil(F.col("homes") / block), F.lit(1)).cast("int").alias("hs"))
    cells = cells.join(size, ["label", "dim", "cell"])
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    ask = cells.withColumns({"q": part("qs"), "h": F.explode(F.sequence(F.lit(0), F.col("hs") - 1)), "asks": F.lit(True)})
    told = cells.where("home").withColumns({"h": part("hs"), "q": F.explode(F.sequence(F.lit(0), F.col("qs") - 1)), "asks": F.lit(False)})
    key = ["label", "dim", "cell", "q", "h"]
    both = ask.unionByName(told).select(*key, "asks", "id", "m", "embedding")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, told = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if ask.empty or told.empty:
            return pd.DataFrame({"id": [], "n": [], "root": []})
        ids, pos = np.unique(pdf["id"].to_numpy(), return_inverse=True)
        a, b = pos[pdf["asks"].to_numpy()], pos[~pdf["asks"].to_numpy()]
        x, y = (unit(np.stack(p["embedding"].to_numpy()).astype(np.float64)) for p in (ask, told))
        m = told["m"].to_numpy()
        n, root = np.zeros(len(ask), np.int64), np.arange(len(ids))
        for at in range(0, len(x), 256):
            near = x[at : at + 256] @ y.T >= threshold
            n[at : at + 256] = near @ m
            i, j = np.nonzero(near)
            held = np.arange(len(ids))
            root = forest(len(ids), np.r_[a[at + i], held], np.r_[b[j], root])
        # a told row may be linked to others only by way of the one that asks, so it is named, too
        out = pd.DataFrame({"id": ids[np.r_[a, b]], "n": np.r_[n, np.zeros(len(b), np.int64)], "root": ids[root[np.r_[a, b]]]})
        return out[(out["n"] > 0) | (out["id"] != out["root"])]

    return both.groupBy(*key).applyInPandas(each, "id long, n long, root long")


def embedding_groups(
    vectors: DataFrame, threshold: float = 0.93, block: int = 4096, sample: int = 8192, most_cells: int = 256
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of `vectors`.

    Equal vectors of a label are one class with a count, so a group of copies costs one row.
    Centroids come from at most `sample` classes (by a hash of the id), one for each `block`
    classes of the largest label, at most `most_cells`; cells that are still crowded are cut
    again in the same way. Every class is assigned and compared.
    A row without label or a sound vector has no link, its own id as component, and is kept.
    Rows without vec_id link and count, but name no component unless another row does. Vectors
    of unequal length are never compared. An empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    classes = usable(rows).groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("m"))
    # classes are numbered by their smallest vec_id; without one, by a hash below all ids
    classes = classes.withColumn("id", F.coalesce("low", -F.abs(F.xxhash64("label", "embedding")) / 2)).withColumn("id", F.col("id").cast("long"))
    classes = cut(classes.withColumn("dim", F.size("embedding")))
    centroids = {}
    sizes = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count")).collect()
    for dim, largest in sizes:
        got = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("id")).limit(sample).select("embedding").toPandas()
        x = unit(np.stack(got["embedding"].to_numpy()).astype(np.float64))
        centroids[dim] = spherical_kmeans(x, int(min(most_cells, max(1, -(-largest // block)), len(x))))
    cells = cut(cell_rows(classes.select("label", "dim", "id", "m", "embedding"), centroids, threshold))
    cells = split_cells(cells, threshold, block, sample, most_cells)
    found = cut(cosine_links(cells, threshold, block))
    links = found.groupBy("id").agg((F.sum("n") - 1).alias("n_links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut(named.join(lows, "root").select("label", "embedding", "n_links", "component_id", F.lit(True).alias("sound")))
    own = F.coalesce(F.col("sound"), F.lit(False))
    component = F.when(own, F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.join(named, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.col("vec_id").isNull() & component.isNull()).alias("kept"),
    )


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""
