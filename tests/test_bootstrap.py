import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import aggregates as A


@pytest.mark.parametrize("n", [1, 2, 7, 500, 3_000_000, 1 << 31, (1 << 31) + 12345])
def test_slices_are_the_generators_integers(n):
    got = np.concatenate([A.generator_slice(42, k, n) for k in range(3)])
    want = np.random.default_rng(42).integers(0, n, size=len(got))
    assert (got == want).all() and (n not in (3_000_000, (1 << 31) + 12345) or len(got) < 3 * A.SLICE)


@pytest.mark.parametrize("held", [1_000_000, 10])
def test_equals_one_array_of_all_draws(spark, held):
    draw = np.random.default_rng(0)
    rows = [(c, f"s{k:04d}", int(draw.integers(0, 9)), int(draw.integers(0, 9)), int(draw.integers(5, 60))) for c, n in (("x", 700), ("y", 33), ("z", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "comparison string, cluster string, a long, b long, r long").repartition(5)
    got = {r.comparison: (r.delta, r.low, r.high) for r in A.bootstrap_numpy(df, "comparison", "cluster", "a", "b", "r", draws=900 if held > 10 else 60, seed=7, held=held).collect()}
    for c in "xyz":
        a, b, r = (np.array([row[k] for row in sorted(rows) if row[0] == c], float) for k in (2, 3, 4))
        i = np.random.default_rng(7).integers(0, len(a), (900 if held > 10 else 60, len(a)))
        x = (b[i].sum(axis=1) - a[i].sum(axis=1)) / r[i].sum(axis=1)
        assert got[c] == ((b.sum() - a.sum()) / r.sum(), *np.percentile(x, [2.5, 97.5]))


def test_no_rows(spark):
    df = spark.createDataFrame([], "comparison string, cluster string, a long, b long, r long")
    assert A.bootstrap_numpy(df, "comparison", "cluster", "a", "b", "r").where(F.lit(True)).count() == 0
