"""Approximate neighbours against brute force."""

import math

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 0.5) for i, v in rows], VECTORS).repartition(3)


def brute(rows, k=10):
    rows = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows]
    out = []
    for at, (i, v) in enumerate(rows):
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for b, (j, w) in enumerate(rows) if b != at)[:k]
            out += [(i, r, j, d) for r, (d, j) in enumerate(near, 1)]
    return sorted(out)


def search(spark, rows, **options):
    from pyspark.sql import functions as F

    from eventfold.llm import neighbours
    df = neighbours.neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0, **options)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()))


def test_whole_windows_are_exact_with_ties_copies_and_odd_rows(spark):
    r = np.random.default_rng(1)
    some = [r.integers(-2, 3, 6) for _ in range(40)]
    rows = [(i, some[r.integers(40)] if i % 3 else r.standard_normal(6)) for i in range(900)]
    rows = [(i, v if np.any(v) else np.ones(6)) for i, v in rows] + [(100, some[1]), (100, some[1]), (5, some[1])]
    rows = [(i, v) for i, v in rows if np.any(v)]
    odd = [(1000, None), (1100, []), (1200, [0] * 6), (1300, [math.nan] + [1] * 5), (1400, [math.inf] + [1] * 5), (1500, [None] + [1] * 5), (1600, [1, 2]), (None, [1] * 6)]
    got, want = search(spark, rows + odd, window=10 ** 6, orderings=4), brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14, atol=0)


def test_few_rows_and_empty_table(spark):
    assert search(spark, []) == []
    assert search(spark, [(100, [0, 0])]) == []
    assert search(spark, [(100, [1, 0])]) == []
    assert [x[:3] for x in search(spark, [(0, [1, 0]), (1, [1, 0]), (2, [0, 1])])] == [(0, 1, 1), (0, 2, 2)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall_on_clusters_and_on_noise(spark, spread):
    r = np.random.default_rng(7)
    centres = r.standard_normal((30, 24))
    rows = [(i, centres[r.integers(30)] + spread * r.standard_normal(24)) for i in range(4000)]
    got, want = search(spark, rows), brute(rows)
    assert len(got) == len(want)
    assert len({g[0::2] for g in got} & {w[0::2] for w in want}) >= 0.9 * len(want)


def test_hilbert_is_a_curve():
    from eventfold.llm import neighbours
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        key = neighbours.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()
