from __future__ import annotations

import math

import numpy as np
import pytest

from logloom.llm import negatives
from logloom.llm.common import table
from tests.llm.helpers import clashing

SCHEMA = "vec_id bigint, embedding array<float>, label int"
TOP = (1 << 63) - 1


def brute(rows, every=50):
    """All answers by comparing every anchor with every row."""
    good = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            moved = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            good.append((i, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in v], moved))
    out = []
    for a, (i, x, label) in enumerate(good):
        if i is None or i % every:
            continue
        scored = []
        for c, (j, y, other) in enumerate(good):
            if c != a and len(x) == len(y):
                s = min(max(sum(p * q for p, q in zip(x, y)), -TOP - 1), TOP)
                scored.append((-s, j is None, j or 0, c, other == label, j))
        scored.sort(key=lambda r: r[:4])
        for s, _, _, _, _, j in [r for r in scored if r[4]][:5]:
            hard = [r for r in scored if not r[4] and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(str(i), str(j), n + 1, str(r[5]), -s, -r[0]) for n, r in enumerate(hard)]
    return sorted(out)


def collect(df):
    return sorted((str(r.anchor_id), str(r.positive_id), r["rank"], str(r.negative_id), r.positive_score, r.negative_score) for r in df.collect())


def clustered(seed, n, size, spread=0.3, labels=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels, size)) + 1.0
    return [(i, [float(np.float32(v)) for v in centers[i % labels] + spread * rng.normal(size=size)], i % labels) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(negatives, "TREE", 8)
    monkeypatch.setattr(negatives, "BATCH", 32)


def test_equals_brute_force_with_odd_rows(spark, small):
    rows = clustered(1, 160, 4)
    rows += [(0, rows[0][1], 0), (0, rows[9][1], 2), (50, rows[50][1], 2), (None, rows[7][1], 3), (None, rows[50][1], 1)] + [(901 + i, rows[3][1], 3) for i in range(60)]
    rows += [(350, None, 1), (400, [1.0, None, 0.0, 2.0], 1), (450, [float("nan"), 1.0, 1.0, 1.0], 1), (500, [1.0] * 4, None), (550, [0.0] * 4, 1), (600, [], 1), (601, [], 2), (602, [], 1)]
    rows += [(650, [1.0, 2.0], 5), (651, [1.0, 2.0], 5), (653, [1.0, 0.5], 6), (700, [-1.0] * 4, 7), (703, [-1.0, 1.0, 1.0, -9.0], 7)]
    df = clashing(spark.createDataFrame([(i, v, label) for i, v, label in rows], SCHEMA)).withColumn("anchor", df_col()).repartition(5)
    want = brute(rows, 10)
    assert len(want) > 100 and collect(negatives.mine(df, every=10)) == want
    assert collect(negatives.mine(df, every=10, pass_bytes=1)) == want  # a pass for every tree


def df_col():
    from pyspark.sql import functions as F

    return F.lit("x")


def test_large_components(spark, small):
    rows = clustered(2, 60, 3) + [(100 + i, [float(np.float32(10.0**i)), -3.0, 1.0], i % 4) for i in range(0, 38, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collect(negatives.mine(df, every=10)) == brute(rows, 10)


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0, 1.0], 3), (2, [1.0, 1.0], 4), (3, [0.5, 1.0], 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collect(negatives.mine(df)) == brute(rows) and negatives.mine(df.limit(0)).count() == 0
    assert negatives.mine(df.limit(0)).columns == negatives.mine(df).columns


def test_spanning_tree_is_minimal():
    x = np.random.default_rng(4).integers(-9, 9, (40, 3))
    order, parent, edge = negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and all(p < at for at, p in enumerate(parent))
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(edge[1:], away[order[1:], order[parent[1:]]])
    # Kruskal's sum of edges
    group, total = list(range(40)), 0.0
    for d, i, j in sorted((away[i, j], i, j) for i in range(40) for j in range(i)):
        if group[i] != group[j]:
            total, old, new = total + d, group[i], group[j]
            group = [new if g == old else g for g in group]
    assert edge.sum() == pytest.approx(total)


def test_bounds_hold_and_spare_scores():
    """Candidates left out by bounds are outside the window; near anchors spare most scores."""
    rng = np.random.default_rng(5)
    anchors = np.concatenate([rng.normal(size=(1, 16)) * 5 + 0.02 * rng.normal(size=(32, 16)) for _ in range(4)])
    order, parent, edge = negatives.spanning_tree(negatives.scaled(anchors, 256))
    tree = {"dimension": 16, "parents": parent, "edges": edge, "rows": list(range(128)), "labels": [0] * 128, "vectors": anchors[order].tobytes()}
    x = negatives.scaled(rng.normal(size=(3000, 16)), 256)
    scores = x @ negatives.scaled(anchors[order], 256).T
    walk = negatives.Walk(tree, negatives.Negatives, {r: [int(1.05 * scores[:, r].max())] for r in range(128)})
    labels, ids = np.ones(3000, np.int64), np.arange(3000)
    taken = walk.against(x, labels, ids, np.zeros(3000, bool), ids + 1000)
    for r, window in enumerate(walk.windows):
        (least, most, best), = window.windows
        inside = [(-s, i) for i, s in enumerate(scores[:, r].tolist()) if least <= s <= most]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == sorted(inside)[:3]
    assert taken < 0.3 * 3000 * 128


def test_given_table_equals_brute_force(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert collect(negatives.mine(df)) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
