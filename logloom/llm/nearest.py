"""Approximate nearest neighbours in a hierarchical k-means tree, searched best bin first.

The tree is fitted by spherical k-means, 16 ways on each of two to four levels, so that a leaf holds some hundred vectors
up to 26 million rows; the fit takes ``SAMPLE`` vectors (more for deeper trees), those with the smallest hash of their id. Every
vector is then put into its leaf. A query walks the tree with a priority queue: the
nearest open node is taken first, an inner node adds its children, a leaf is visited. How many leaves to visit
is calibrated: for ``PROBES`` of the queries the exact neighbours are found by comparing them with all vectors in
blocks, and visits are doubled until the tree finds at least 97 % of them.

Leaves are cut into blocks of about ``BLOCK`` vectors, so a vector that makes up a third of all rows fills many
blocks and no task grows. A block holds its vectors while the queries that visit the leaf stream past, and hands
on five results per query. The tree has at most 65,536 leaves, which bounds what is sent to the tasks; beyond that leaves grow.

Scores are cosines in double precision, summed the same way whatever the block, so equal vectors tie exactly and
ties go to the smaller vec_id. Vectors that are NULL, zero, hold a NULL or a non-finite component, or have another
dimension than most, take no part; neither do rows without vec_id. Rows that repeat a vec_id are queries and candidates
each: a query leaves out its own row only, and the results of two queries with one id stand side by side. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import Scratch

EVERY = 50
K = 5
BRANCH = 16
SAMPLE = 20_000  # for two levels; a deeper tree takes eight times as many for each further level
LEAF_ROWS = 400
MOST_DEPTH = 4
ROUNDS = 12
PROBES = 64
RECALL = 0.97
BLOCK = 4096
FOUND = "query bigint, query_id bigint, vec_id bigint, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        of = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centers)
    return centers, (x @ centers.T).argmax(axis=1)


def depth_for(rows: int) -> int:
    """Levels of a tree whose leaves hold about ``LEAF_ROWS`` vectors."""
    return min(max(2, math.ceil(math.log(max(rows, 1) / LEAF_ROWS, BRANCH))), MOST_DEPTH)


class Tree:
    """Centers by level, ``BRANCH`` under every node; child c of node n is node n * BRANCH + c of the next level."""

    def __init__(self, sample: np.ndarray, depth: int = 2, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.levels: list[np.ndarray] = []
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            centers = np.empty((BRANCH ** level, BRANCH, sample.shape[1]))
            below = np.empty(len(sample), np.int64)
            # Nodes without vectors of the sample repeat their own center; no vector gets beyond its first child.
            centers[:] = sample[:1] if not level else self.levels[-1].reshape(-1, 1, sample.shape[1])
            order = np.argsort(node, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                found, of = _kmeans(sample[own], BRANCH, rng)
                centers[node[own[0]], :len(found)] = found
                centers[node[own[0]], len(found):] = found[:1]
                below[own] = of
            self.levels.append(centers)
            node = node * BRANCH + below
        self.leaves = BRANCH ** depth

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for centers in self.levels:
            below = np.empty(len(x), np.int64)
            order = np.argsort(node, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                if len(own):
                    below[own] = (x[own] @ centers[node[own[0]]].T).argmax(axis=1)
            node = node * BRANCH + below
        return node

    def visits(self, x: np.ndarray, leaves: int, held: dict[int, int]) -> list[int]:
        """The first leaves of a query best bin first; more if these hold too few vectors."""
        queue = [(-2.0, 0, 0)]
        out, seen = [], 0
        while queue and (len(out) < leaves or seen <= K):
            _, level, node = heapq.heappop(queue)
            if level < len(self.levels):
                for c, s in enumerate((self.levels[level][node] @ x).tolist()):
                    heapq.heappush(queue, (-s, level + 1, node * BRANCH + c))
            elif held.get(node):
                out.append(node)
                seen += held[node]
        return out


def scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines; a row's sum does not depend on the rows around it."""
    norms = np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum())
    return (vectors * query).sum(axis=1) / norms


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(query: tuple[int, int], x: np.ndarray, unit: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, units: np.ndarray) -> list[tuple]:
    """The K best of a block but the query's own row: a matrix product finds the candidates, exact scores order them."""
    rough = np.where(rows == query[0], -2.0, units @ unit)
    bound = np.partition(rough, -K)[-K] if len(rough) > K else -1.5
    at = np.flatnonzero((rough >= bound - 1e-9) & (rows != query[0]))
    exact = scores(x, vectors[at])
    order = np.lexsort([ids[at], -exact])[:K]
    return [(*query, int(ids[at[i]]), float(exact[i])) for i in order]


def _table(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "query_id", "vec_id", "score"])


def _leaves(tree: Tree):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding")
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("vec_id"), pa.array(tree.leaf(_unit(x)).astype(np.int32)), pa.array([r.tobytes() for r in x])],
                    names=["row", "vec_id", "leaf", "vector"],
                )

    return assign


def _walk(tree: Tree, leaves: int, held: dict[int, int]):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("vector")))
            visits = [tree.visits(q, leaves, held) for q in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("vector"), pa.array(visits, pa.list_(pa.int32()))],
                names=["row", "vec_id", "vector", "leaves"],
            )

    return walk


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by leaf block, vectors first; these are held while queries pass by."""
    group, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("leaf", "block", "asks")]
        x = _matrix(batch.column("vector"))
        columns = [batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), x, _unit(x)]
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
        cuts, found = [*np.flatnonzero(new).tolist(), batch.num_rows], []
        for low, high in zip(cuts, cuts[1:]):
            here = (key[0][low], key[1][low])
            if not key[2][low]:
                part = [c[low:high] for c in columns]
                held = [np.concatenate(both) for both in zip(held, part)] if here == group else part
                group = here
            elif here == group:
                for i in range(low, high):
                    found += _best((int(columns[0][i]), int(columns[1][i])), x[i], columns[3][i], *held)
        yield _table(found)


def _against_all(probes: list[tuple[int, int, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, found = _matrix(batch.column("vector")), []
                held = [batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), x, _unit(x)]
                for row, key, raw in probes:
                    q = np.frombuffer(raw, np.float64)
                    found += _best((row, key), q, _unit(q[None])[0], *held)
                yield _table(found)

    return run


def _ranked(found: DataFrame) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= K)
    return ranked.select("query", "query_id", "rank", "vec_id", "score")


def usable(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, embedding) of the vectors that take part, as doubles; ``row`` tells rows of one vec_id apart."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint"), x.cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
    sizes = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size(x) == (sizes[0].n if sizes else 0)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")


def search(queries: DataFrame, indexed: DataFrame, blocks: DataFrame, tree: Tree, leaves: int, held: dict[int, int]) -> DataFrame:
    """The K best found for every query over its first ``leaves`` leaves."""
    walked = queries.mapInArrow(_walk(tree, leaves, held), "row bigint, vec_id bigint, vector binary, leaves array<int>")
    asks = walked.select("row", "vec_id", "vector", F.explode("leaves").alias("leaf")).join(F.broadcast(blocks), "leaf")
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    asks = asks.select("leaf", block, F.lit(True).alias("asks"), "row", "vec_id", "vector")
    stand = indexed.select("leaf", "block", F.lit(False).alias("asks"), "row", "vec_id", "vector")
    rows = stand.union(asks).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "asks")
    return _ranked(rows.mapInArrow(_pass, FOUND))


def nearest(embeddings: DataFrame, every: int = EVERY, recall: float = RECALL) -> DataFrame:
    """Neighbours of every row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession, "nearest")
    vectors = scratch.save(usable(embeddings), "vectors")
    depth = depth_for(vectors.count())
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE * 8 ** (depth - 2)).select("embedding").toArrow().column(0).combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    flat = sample.flatten().to_numpy(zero_copy_only=False)
    tree = Tree(_unit(flat.reshape(len(sample), -1)), depth)
    leafed = scratch.save(vectors.mapInArrow(_leaves(tree), "row bigint, vec_id bigint, leaf int, vector binary"), "leafed")
    held = {r.leaf: r["count"] for r in leafed.groupBy("leaf").count().collect()}  # at most BRANCH ** MOST_DEPTH leaves
    blocks = spark.createDataFrame([(leaf, -(-n // BLOCK)) for leaf, n in held.items()], "leaf int, blocks int")
    indexed = leafed.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    queries = leafed.filter(F.pmod("vec_id", F.lit(every)) == 0).select("row", "vec_id", "vector")
    probes = scratch.save(queries.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(PROBES), "probes")
    probe_rows = [(r.row, r.vec_id, bytes(r.vector)) for r in probes.collect()]
    exact = _ranked(leafed.select("row", "vec_id", "vector").mapInArrow(_against_all(probe_rows), FOUND)).collect()
    leaves, least = 8, {}
    for r in exact:
        least[r.query] = min(r.score, least.get(r.query, 2.0))
    while leaves < tree.leaves:
        found = search(probes, indexed, blocks, tree, leaves, held).collect()
        if sum(r.score >= least[r.query] for r in found) >= recall * len(exact):
            break
        leaves *= 2
    return scratch.save(search(queries, indexed, blocks, tree, leaves, held), "found").drop("query")
