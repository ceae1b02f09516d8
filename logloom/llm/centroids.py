"""Centroid clustering in whole numbers, with a vantage-point tree over the centroids.

Vectors with exactly ``DIMENSION`` components, none NULL or non-finite, take part; a component x becomes the integer
floor(64 * x). In every round a vantage-point tree is built over the centroids and sent to the tasks. Each vector walks
it best bound first: the open node with the smallest lower bound comes next, the exact squared distance to the node's
centroid is taken, and a half of the tree is left out only if its bound is above the best distance. Bounds are rounded
down, and a node whose bound equals the best stays open, so ties are always seen and go to the smaller number.
All vectors of a batch walk at once, each with its own queue: a row of bounds.

A task adds up its vectors by centroid and hands on one row per centroid, component and 48-bit limb, so no vector is
shuffled, a vector that stands a third of the time costs what any other does, and the driver gets ``K`` sums of each
component. Sums, means (floor) and distances are exact; components too large for 64-bit arithmetic are computed with
Python's integers and without bounds. A distance or inertia above 2^63 - 1 is given as 2^63 - 1.

Starts are the ``K`` vectors with the smallest SHA-256 of ``1:<vec_id>``; rows of one vec_id follow by their components,
those without vec_id come last. Fewer vectors give fewer centroids, an empty table gives no rows. Repeated rows are
clustered each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import Scratch

DIMENSION = 64
K = 16
ROUNDS = 3
SCALE = 64
LONGEST = (1 << 63) - 1
# Components up to this size leave room for a squared distance of 2^16 components in 64 bits.
NARROW = 1 << 22
LIMB = 48
SUMS = "cluster int, place int, limb int, total bigint"


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact: 64-bit integers, or Python's where a component is large."""
    if not x.size or np.abs(x).max() * scale <= NARROW:
        return np.floor(x * scale).astype(np.int64)
    # Doubles from 2^53 on are whole numbers, below that their product with a power of two is exact.
    whole = lambda v: math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale
    return np.array([[whole(v) for v in row] for row in x.tolist()], dtype=object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to one point."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=1)


def as_matrix(points: list[list[int]]) -> np.ndarray:
    narrow = all(abs(v) <= NARROW for p in points for v in p)
    return np.array(points, dtype=np.int64 if narrow else object)


class VantageTree:
    """Vantage points of centroids: a node's nearer half lies within its radius, the other at or beyond ``far``.

    ``nodes``: (centroid number, largest distance in the near half, smallest in the far half, near child, far child), with
    -1 for a missing child. A child comes after its parent.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple[int, float, float, int, int]] = []
        if len(points):
            self._build(list(range(len(points))))

    def _build(self, members: list[int]) -> int:
        at, (own, *rest) = len(self.nodes), members
        self.nodes.append((own, 0.0, 0.0, -1, -1))
        if rest:
            away = squared(self.points[rest], self.points[own]).tolist()
            order = sorted(range(len(rest)), key=lambda i: (away[i], rest[i]))
            half = (len(order) + 1) // 2
            near, far = order[:half], order[half:]
            wide = self.points.dtype == object
            inner, outer = (math.inf, 0.0) if wide else (math.sqrt(away[near[-1]]), math.sqrt(away[far[0]]) if far else math.inf)
            self.nodes[at] = (
                own, inner, outer,
                self._build([rest[i] for i in near]), self._build([rest[i] for i in far]) if far else -1,
            )
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of every row, its exact squared distance, and how many distances were taken."""
        n, taken = len(x), 0
        wide = x.dtype == object or self.points.dtype == object
        best = np.full(n, math.inf if wide else LONGEST, dtype=object if wide else np.int64)
        cluster = np.full(n, -1, np.int32)
        root = np.full(n, np.inf)  # root of the best distance, rounded up
        bounds = np.full((n, len(self.nodes)), np.inf)
        if len(self.nodes):
            bounds[:, 0] = 0.0
        open_rows = np.arange(n if len(self.nodes) else 0)
        while len(open_rows):
            queue = bounds[open_rows]
            node = queue.argmin(axis=1)
            bound = queue[np.arange(len(open_rows)), node]
            going = (bound <= root[open_rows]) & (bound < np.inf)
            open_rows, node, bound = open_rows[going], node[going], bound[going]
            bounds[open_rows, node] = np.inf
            for at in np.unique(node).tolist():
                rows, low = open_rows[node == at], bound[node == at]
                own, inner, outer, near, far = self.nodes[at]
                d = squared(x[rows], self.points[own])
                taken += len(rows)
                better = np.asarray((d < best[rows]) | ((d == best[rows]) & (own < cluster[rows])), bool)
                best[rows[better]], cluster[rows[better]] = d[better], own
                if wide:  # no roots of such numbers: every node stays open
                    for child in {near, far} - {-1}:
                        bounds[rows, child] = 0.0
                    continue
                away = np.sqrt(d.astype(np.float64))
                root[rows[better]] = away[better] * (1 + 1e-9)
                # Roots are off by less than the slack, so a bound is never above the true distance.
                slack = 1e-9 * away
                if near >= 0:
                    bounds[rows, near] = np.maximum(low, away - inner - slack - 1e-9 * inner)
                if far >= 0:
                    bounds[rows, far] = np.maximum(low, outer - away - slack - 1e-9 * outer)
        return cluster, best, taken


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(limb, digit) of a number in signed base 2^48."""
    sign, rest, limb = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        digit = rest & ((1 << LIMB) - 1)
        if digit:
            yield limb, sign * digit
        rest, limb = rest >> LIMB, limb + 1


def _sums(tree: VantageTree, scale: int) -> Callable:
    """One row per centroid, component and limb of a task's sums; component -1 counts the vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            x = scaled(_vectors(batch), scale)
            cluster, _, _ = tree.nearest(x)
            for c in np.unique(cluster).tolist():
                at = cluster == c
                for place, value in enumerate([int(at.sum()), *x[at].sum(axis=0).tolist()], -1):
                    total[c, place] = total.get((c, place), 0) + int(value)
        rows = [(c, place, limb, digit) for (c, place), value in total.items() for limb, digit in _limbs(value)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cluster", "place", "limb", "total"])

    return add


def _assign(tree: VantageTree, scale: int) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = tree.nearest(scaled(_vectors(batch), scale))
            kept = [min(int(d), LONGEST) for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(kept, pa.int64())], names=["vec_id", "cluster", "distance"])

    return assign


def kept_vectors(embeddings: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.select(F.col("vec_id").cast("bigint"), x.alias("embedding")).filter((F.size(x) == dimension) & finite)


def starts(vectors: DataFrame, k: int) -> list[list[float]]:
    """The first centroids: at most ``k`` rows, by the hash of their id."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.withColumn("hash", hashed).orderBy(F.asc_nulls_last("hash"), "embedding").limit(k)
    return [[float(v) for v in r.embedding] for r in first.collect()]


def moved(centroids: list[list[int]], sums: DataFrame) -> list[list[int]]:
    """Every non-empty centroid replaced by the floor of its vectors' mean."""
    merged = sums.groupBy("cluster", "place", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total: dict[tuple[int, int], int] = {}
    for r in merged.collect():  # centroids x components x limbs
        total[r.cluster, r.place] = total.get((r.cluster, r.place), 0) + (int(r.total) << (LIMB * r.limb))
    return [
        [total.get((c, place), 0) // total[c, -1] for place in range(len(own))] if (c, -1) in total else own
        for c, own in enumerate(centroids)
    ]


def _digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession, "centroids")
    vectors = scratch.save(kept_vectors(embeddings, dimension), "vectors", rows=4096)
    first = starts(vectors, k)
    centroids = scaled(np.array(first, np.float64).reshape(len(first), dimension), scale).tolist()
    for _ in range(rounds if centroids else 0):
        tree = VantageTree(as_matrix(centroids))
        centroids = moved(centroids, vectors.mapInArrow(_sums(tree, scale), SUMS))
    tree = VantageTree(as_matrix(centroids))
    assigned = scratch.save(vectors.mapInArrow(_assign(tree, scale), "vec_id bigint, cluster int, distance bigint"), "assigned")
    return _with_inertia(spark, assigned, centroids)


def _with_inertia(spark: SparkSession, assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = sum(int(r.total) for r in by_cluster)
    rows = [(r.cluster, min(int(r.total), LONGEST), min(inertia, LONGEST), _digest(centroids[r.cluster])) for r in by_cluster]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    nearest = """
  SELECT v.r, min_by(c.n, (list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.n)) AS n,
    min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
  FROM kept v CROSS JOIN {c} c GROUP BY v.r"""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS x
  FROM embeddings WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}
)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS n, x FROM kept QUALIFY n < {K}
)"""]
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(c=f'c{i}')}\n)")
        steps.append(f"""s{i} AS MATERIALIZED (
  SELECT a.n, p.i, sum(v.x[p.i]) AS s, count(*)::HUGEINT AS m FROM a{i} a JOIN kept v USING (r) CROSS JOIN (SELECT unnest(range(1, {DIMENSION + 1})) AS i) p GROUP BY a.n, p.i
)""")
        steps.append(f"""m{i} AS MATERIALIZED (
  SELECT n, list((s - ((s % m) + m) % m) // m ORDER BY i) AS x FROM s{i} GROUP BY n
)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (n))")
    steps.append(f"final AS MATERIALIZED ({nearest.format(c=f'c{ROUNDS}')}\n)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, a.n::INTEGER AS "cluster", a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.n))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM final a JOIN kept v USING (r) JOIN c{ROUNDS} c USING (n)"""


SQL = _sql()
