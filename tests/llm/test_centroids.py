from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from logloom.llm import centroids
from logloom.llm.common import table
from tests.llm.helpers import clashing

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=16, rounds=3, dimension=64):
    """{(vec_id, cluster, distance, cluster_inertia, inertia, sha): times} by a direct loop over all centroids."""
    kept = [(i, [64 * int(v) if abs(v) > 2**53 else math.floor(64 * v) for v in x], x) for i, x in rows if x is not None and len(x) == dimension and all(v is not None and math.isfinite(v) for v in x)]
    sha = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centers = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha(r[0]), r[2]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v, _ in kept]
        for n in set(of):
            own = [v for (_, v, _), o in zip(kept, of) if o == n]
            centers[n] = [sum(c) // len(own) for c in zip(*own)]
    found = [nearest(v) for _, v, _ in kept]
    top = (1 << 63) - 1
    inertia = [sum(min(d, top) for d, n in found if n == c) for c in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((str(i), n, min(d, top), min(inertia[n], top), min(sum(inertia), top), digest[n]) for (i, _, _), (d, n) in zip(kept, found))


def collect(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_equals_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 0.1]) for i in range(150)]
    rows += [(0, rows[0][1]), (0, rows[5][1]), (None, rows[7][1]), (None, [0.5, 0.0, 0.0, 0.25])] + [(900 + i, rows[3][1]) for i in range(60)]
    rows += [(201, None), (202, [1.0, None, 0.0, 2.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("-inf"), 1.0, 1.0, 1.0]), (205, [1.0] * 3), (206, []), (207, [0.0] * 4)]
    df = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).repartition(5)
    assert collect(centroids.cluster(df, dimension=4)) == brute(rows, dimension=4)


def test_ties_repeated_starts_and_few_vectors(spark):
    grid = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(a, b) for a in range(6) for b in range(6)] * 3)]
    df = spark.createDataFrame([(i, v, 0) for i, v in grid], SCHEMA)
    assert collect(centroids.cluster(df, dimension=2)) == brute(grid, dimension=2)
    few = df.filter("vec_id < 3")
    assert collect(centroids.cluster(few, dimension=2)) == brute(grid[:3], dimension=2)
    assert centroids.cluster(df).count() == 0 and centroids.cluster(df.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [3e38 * (i % 3 - 1), 1e7 * i, -0.001, 2.0**30]) for i in range(20)] + [(50 + i, [float(i), -float(i), 0.5, 70000.25]) for i in range(20)]
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in rows]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert collect(centroids.cluster(df, dimension=4)) == brute(rows, dimension=4)
    far = [(i, [1e300 * (-1) ** i, 2.5 * i, 1e-300, 5e180 * i]) for i in range(30)]
    doubles = spark.createDataFrame(far, "vec_id bigint, embedding array<double>")
    assert collect(centroids.cluster(doubles, dimension=4)) == brute(far, dimension=4)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 300])
def test_tree_finds_the_nearest_and_prunes(size):
    rng = np.random.default_rng(size)
    points, x = rng.integers(-40, 40, (size, 3)), rng.integers(-50, 50, (800, 3))
    cluster, best, taken = centroids.VantageTree(points).nearest(x)
    all_d = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (best == all_d.min(axis=1)).all() and (cluster == all_d.argmin(axis=1)).all()
    if size == 300:
        assert taken < 0.6 * x.shape[0] * size


def test_given_table_equals_brute_force(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert collect(centroids.cluster(df)) == brute([(r.vec_id, r.embedding) for r in df.collect()])
