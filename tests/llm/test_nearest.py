from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

from logloom.llm import nearest
from logloom.llm.common import table
from tests.llm.helpers import clashing

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            ranked = sorted((-float(nearest.scores(x, v[None])[0]), i) for i, v in good if i != q)
            out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def collect(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_small_tables_are_exact(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, [0.0] * 4), (201, None), (202, [1.0, None, 0.0, 2.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0, 1.0]), (210, [1.0, 2.0]), (None, [1.0] * 4), (205, [-x for x in rows[5][1]])]
    df = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).repartition(3)
    got, want = collect(nearest.nearest(df, every=5, recall=1.1)), brute([r for r in rows if r[0] != 210], 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-15)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [0.0, 3.0], 0)], SCHEMA)
    assert {k: [i for i, _ in v] for k, v in collect(nearest.nearest(df)).items()} == {0: [1, 2]}
    assert nearest.nearest(df.limit(0)).count() == 0


def test_recall(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = collect(nearest.nearest(df))
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 50)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    print("recall", hits / sum(map(len, want.values())), len(want))
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))


def test_rows_that_share_an_id_are_queries_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (3, [1.0, 0.2]), (4, [0.1, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 4)) for r in nearest.nearest(df).collect())
    want = []
    for q, x in rows[:3]:
        others = list(rows)
        others.remove((q, x))
        ranked = sorted((-float(nearest.scores(np.array(x), np.array([v]))[0]), i) for i, v in others)
        want += [(q, n, i, round(-s, 4)) for n, (s, i) in enumerate(ranked, 1)]
    assert got == sorted(want) and len(got) == 12


def test_deeper_trees_for_larger_tables(spark, monkeypatch):
    assert [nearest.depth_for(n) for n in (0, 2000, 51_282, 102_400, 1_000_000, 10**7, 10**10)] == [2, 2, 2, 2, 3, 4, 4]
    monkeypatch.setattr(nearest, "LEAF_ROWS", 4)
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    assert nearest.depth_for(df.count()) == 3
    got = collect(nearest.nearest(df))
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 50)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))
