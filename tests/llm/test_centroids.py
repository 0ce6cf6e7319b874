"""Clusters against whole-number k-means in plain Python, and the bounds by themselves."""

import hashlib
import math

import numpy as np
import pytest

from graphloom.llm import centroids, queries
from graphloom.session import table

SF = "/root/testdata/sf0.01"


def plain(rows, size, k=8, rounds=10, scale=1024):
    """(id, cluster, distance) of each row, inertia by cluster, digests of the centroids."""
    whole = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(whole, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((apart(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            c[j] = [sum(x) // len(g) for x in zip(*g)]
    out = [(i, *near(v)[::-1]) for i, v in whole]
    sums = {}
    for _, j, d in out:
        sums[j] = sums.get(j, 0) + d
    return sorted((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, queries.op13_centroids(spark, SF).collect())) == plain(rows, 64)


def test_odd(spark):
    good = [(i, [float(i % 5), -0.5 * (i % 3), i / 7]) for i in range(200)] + [(5, [9.0, 9.0, 9.0])] * 40 + [(1000, [0.0, 0.0, 0.0]), (1001, [-0.0, 130_000.0, -131_000.0])]
    odd = [(300, None), (301, []), (302, [1.0, None, 2.0]), (303, [1.0, float("nan"), 0.0]), (304, [float("-inf"), 0.0, 0.0]), (305, [1.0, 2.0]), (306, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in good + odd], "vec_id long, embedding array<double>, cluster int, p string, distance double").repartition(5)
    got = sorted(map(tuple, centroids.cluster(df, size=3).collect()))
    assert got == plain(good, 3)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [7.0, 1.0])]])
def test_few(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, centroids.cluster(df, size=2).collect())) == plain(rows, 2)


def test_null_id(spark):
    rows = [(i, [float(i)]) for i in range(9)] + [(None, [3.5])]
    got = {(r.vec_id, r.cluster) for r in centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=1).collect()}
    assert len(got) == 10


@pytest.mark.parametrize("spread", [3, 1000, 1 << 26])
def test_bounds_hold(spread):
    """No bound passes a true distance, pivots and rows that coincide with a centroid among them."""
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (3000, 8))
    c = np.concatenate([x[:5], rng.integers(-spread, spread + 1, (3, 8))])
    pivots = np.unique(np.concatenate([c[:4], x[50:60]]), axis=0)
    cached = np.stack([np.sqrt(centroids.squared(x, p).astype(float)) for p in pivots], 1).astype(np.float32).astype(float)
    nearest = centroids.Nearest(c, pivots)
    true = np.stack([centroids.squared(x, m) for m in c])
    low = nearest.bounds(cached)
    assert (low * low * (1 - centroids.SLACK) <= true).all()
    near, best, _ = nearest(x, cached)
    assert (near == true.argmin(0)).all() and (best == true.min(0)).all()


def test_bounds_spare_distances():
    """Around clear centres less than a third of all distances are computed."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (8, 64))
    x = centres[rng.integers(0, 8, 5000)] + rng.integers(-200, 201, (5000, 64))
    start = x[:8]
    pivots = centroids.choose_pivots(x[:500], start)
    cached = np.stack([np.sqrt(centroids.squared(x, p).astype(float)) for p in pivots], 1)
    for c in (start, centres):
        done = centroids.Nearest(c, pivots)(x, cached)[2]
        assert done < 8 * len(x) / 3, done
