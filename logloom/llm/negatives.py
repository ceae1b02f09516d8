"""Hard negatives under score bounds carried along spanning trees of anchors.

A component x becomes the integer floor(256 * x), a score is an integer inner product. Anchors (rows whose vec_id is divisible
by ``EVERY``) are dealt in the order of their label and a sketch of their vector into trees of at most ``TREE`` anchors, each
a minimum spanning tree by distance. A task meets its candidates batch by batch. The root of a tree is scored against
all of them; for an anchor below, a candidate's score lies within

    score at the parent  +-  length of the edge x length of the candidate,

and where the parent's own score is known by bounds only, within these widened by the same amount. Only candidates
whose interval reaches into the anchor's window are scored, exactly. There are two passes over all rows: for
the positives the window begins at the fifth best score met so far, for the negatives it is
50 % to 95 % of a positive score, narrowed to what is not yet beaten by three of them. Bounds are rounded outwards, so
nothing in a window is missed; every row is a candidate of every anchor, in blocks.

Trees are taken ``PASS_BYTES`` at a time, which bounds what the driver collects and sends to the tasks; a table with more
anchors takes more passes over the rows. Tasks hand on the best few of an anchor, never a vector, so a
vector, label or vec_id that makes up a third of all rows fills no task.

Rows with a NULL label, a NULL vector, or a NULL or non-finite component take no part; every 7th vec_id gets the next of
``LABELS`` labels first. A row is no candidate of its own, but rows that repeat its vec_id or vector are. Rows without
vec_id are candidates, last among ties, and no anchors. Only vectors of as many components as the anchor are compared;
empty ones score 0. Scores beyond 64 bits count as the end of that range. A negative positive score has an empty
window. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.centroids import NARROW, scaled
from logloom.llm.common import Scratch

EVERY = 50
SHIFTED = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # per cent of the positive score
TREE = 256
PASS_BYTES = 16 << 20
BATCH = 4096
EXACT = 1 << 53  # up to here doubles add up whole numbers exactly
TOP = (1 << 63) - 1
BOTTOM = -(1 << 63)
TREES = "tree bigint, dimension int, rows array<bigint>, labels array<bigint>, parents array<int>, edges array<double>, vectors binary"
NAMES = ["anchor", "positive", "row", "vec_id", "score"]
FOUND = "anchor bigint, positive int, row bigint, vec_id bigint, score bigint"
OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def clipped(values: np.ndarray) -> np.ndarray:
    """Python's integers as 64-bit ones; those beyond the range become its end."""
    return np.array([min(max(int(v), BOTTOM), TOP) for v in values], dtype=np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, infinite beyond the range of doubles."""
    with np.errstate(over="ignore"):
        x = np.minimum(np.abs(x), 2.0**1000).astype(np.float64) if x.dtype == object else x
        return np.sqrt((x * x).sum(axis=1))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree of the rows of x: order of joining, parent (as a place in that order), edge length."""
    n = len(x)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int32), np.zeros(n)
    best, source, joined, place = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int32)
    now = 0
    for at in range(n):
        if at:
            now = int(np.where(joined, np.inf, best).argmin())
            now = int(np.flatnonzero(~joined)[0]) if joined[now] else now
            parent[at], edge[at] = place[source[now]], best[now]
        order[at], place[now], joined[now] = now, at, True
        away = lengths(x - x[now])
        nearer = ~joined & (away <= best)
        best[nearer], source[nearer] = away[nearer], now
    return order, parent, edge


def _tree(rows: pd.DataFrame) -> pd.DataFrame:
    """One tree of a bounded chunk of anchors; vectors are stored as given, in the order of the tree."""
    rows = rows.sort_values("row")
    x = np.stack([np.asarray(v, np.float64) for v in rows["embedding"]])
    order, parent, edge = spanning_tree(scaled(x, SCALE))
    return pd.DataFrame({
        "tree": [int(rows["tree"].iloc[0])], "dimension": [x.shape[1]], "rows": [rows["row"].to_numpy()[order]],
        "labels": [rows["label"].to_numpy()[order]], "parents": [parent], "edges": [edge], "vectors": [x[order].tobytes()],
    })


class Best:
    """The best ``keep`` rows of one anchor or window: higher scores first, ties to smaller vec_id, NULL last."""

    def __init__(self, keep: int):
        self.keep = keep
        self.scores = self.ids = self.rows = np.zeros(0, np.int64)
        self.absent = np.zeros(0, bool)

    @property
    def least(self) -> int | None:
        """A score that a row must reach to be taken; None while any will do."""
        return int(self.scores[-1]) if len(self.scores) == self.keep else None

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, rows: np.ndarray) -> None:
        if len(scores) > 4 * self.keep:
            high = scores >= np.partition(scores, -self.keep)[-self.keep]
            scores, ids, absent, rows = scores[high], ids[high], absent[high], rows[high]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        absent, rows = np.concatenate([self.absent, absent]), np.concatenate([self.rows, rows])
        # The complement turns the order of scores round without overflow.
        order = np.lexsort([rows, ids, absent, ~scores])[:self.keep]
        self.scores, self.ids, self.absent, self.rows = scores[order], ids[order], absent[order], rows[order]


class Positives:
    """Window of an anchor while its positives are looked for: rows of its label from the fifth best score on."""

    def __init__(self, label: int, _: list[int]):
        self.label, self.best = label, Best(POSITIVES)

    def wanted(self, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        least = self.best.least
        mine = labels == self.label
        return mine if least is None else mine & (high >= least)

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, rows: np.ndarray) -> None:
        self.best.add(scores, ids, absent, rows)

    def found(self) -> Iterator[tuple[int, Best]]:
        yield 0, self.best


class Negatives:
    """Windows of an anchor, one per positive score: rows of other labels, while three better ones are not yet known."""

    def __init__(self, label: int, scores: list[int]):
        # LOW * p <= 100 * s <= HIGH * p, for whole s
        self.label = label
        self.windows = [(-(-LOW * p // 100), HIGH * p // 100, Best(NEGATIVES)) for p in scores]

    def wanted(self, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        open_windows = [(self._floor(least, best), most) for least, most, best in self.windows if least <= most]
        if not open_windows:
            return np.zeros(len(labels), bool)
        floor, most = min(f for f, _ in open_windows), max(m for _, m in open_windows)
        return (labels != self.label) & (high >= floor) & (low <= most)

    @staticmethod
    def _floor(least: int, best: Best) -> int:
        return least if best.least is None else max(least, best.least)

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, rows: np.ndarray) -> None:
        for least, most, best in self.windows:
            inside = (scores >= self._floor(least, best)) & (scores <= most)
            if inside.any():
                best.add(scores[inside], ids[inside], absent[inside], rows[inside])

    def found(self) -> Iterator[tuple[int, Best]]:
        yield from ((n, best) for n, (_, _, best) in enumerate(self.windows))


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Labels, vec_ids, which of these are NULL, row numbers."""
    ids = batch.column("vec_id")
    filled = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return batch.column("label").to_numpy(), filled, ids.is_null().to_numpy(zero_copy_only=False), batch.column("row").to_numpy()


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integer vectors) of a batch by number of components, those with large components apart."""
    column = batch.column("embedding")
    sizes = np.array([len(v) for v in column]) if batch.num_rows else np.zeros(0, int)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        large = np.abs(x).max(axis=1, initial=0.0) * SCALE > NARROW
        for part in (~large, large):
            if part.any():
                yield at[part], scaled(x[part], SCALE)


class Walk:
    """One tree with the windows of its anchors."""

    def __init__(self, tree: dict, window: type, scores: dict[int, list[int]]):
        self.dimension, self.parents, self.edges, self.rows = tree["dimension"], tree["parents"], tree["edges"], tree["rows"]
        self.vectors = scaled(np.frombuffer(tree["vectors"], np.float64).reshape(len(self.rows), self.dimension), SCALE)
        self.length = float(lengths(self.vectors).max(initial=0.0))
        self.windows = [window(label, scores.get(row, [])) for label, row in zip(tree["labels"], self.rows)]

    def against(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, absent: np.ndarray, rows: np.ndarray) -> int:
        """Meet the candidates x; returns how many scores were taken."""
        n, taken, away = len(x), 0, lengths(x)
        # Products of lengths bound every partial sum, so doubles are exact up to EXACT.
        exact = x.dtype != object and self.vectors.dtype != object and self.length * away.max(initial=0.0) < EXACT
        floats, points = (x.astype(np.float64), self.vectors.astype(np.float64)) if exact else (x.astype(object), self.vectors.astype(object))
        low, high = np.empty((len(self.rows), n)), np.empty((len(self.rows), n))
        for at, parent in enumerate(self.parents):
            if parent >= 0 and exact:
                width = self.edges[at] * away * (1 + 1e-9) + 1e-3
                low[at], high[at] = low[parent] - width, high[parent] + width
            else:
                low[at], high[at] = -np.inf, np.inf
            window = self.windows[at]
            asked = np.flatnonzero(window.wanted(labels, low[at], high[at])) if parent >= 0 else np.arange(n)
            taken += len(asked)
            if not len(asked):
                continue
            whole = floats @ points[at] if 2 * len(asked) > n else floats[asked] @ points[at]
            scores = whole[asked] if len(whole) == n else whole
            if exact:
                low[at, asked] = high[at, asked] = scores
                scores = scores.astype(np.int64)
            else:
                scores = clipped(scores)
            bounds = scores.astype(np.float64)
            mine = window.wanted(labels[asked], bounds, bounds) & (rows[asked] != self.rows[at])
            if mine.any():
                to = asked[mine]
                window.add(scores[mine], ids[to], absent[to], rows[to])
        return taken


def _search(trees: list[dict], window: type, scores: dict[int, list[int]]) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [Walk(tree, window, scores) for tree in trees]
        for batch in batches:
            own = _batch(batch)
            for at, x in _matrix(batch):
                for walk in walks:
                    if walk.dimension == x.shape[1]:
                        walk.against(x, *[column[at] for column in own])
        for walk in walks:
            out: list[list] = [[] for _ in NAMES]
            for row, anchor in zip(walk.rows, walk.windows):
                for number, best in anchor.found():
                    ids = [None if gone else int(i) for i, gone in zip(best.ids, best.absent)]
                    for column, values in zip(out, ([row] * len(ids), [number] * len(ids), best.rows.tolist(), ids, best.scores.tolist())):
                        column += values
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=NAMES)

    return search


def usable(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, embedding) of the rows that take part, with the labels of every 7th vec_id moved on."""
    x, label = F.col("embedding"), F.col("label").cast("bigint")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    moved = F.when(F.col("vec_id") % SHIFTED == 0, ((label.cast("decimal(20,0)") + 1) % LABELS).cast("bigint")).otherwise(label)
    rows = embeddings.select(F.col("vec_id").cast("bigint"), moved.alias("label"), x.alias("embedding"))
    return rows.filter(F.col("label").isNotNull() & x.isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), "*")


def planted(rows: DataFrame, every: int = EVERY, size: int = TREE) -> DataFrame:
    """Spanning trees of the anchors, at most ``size`` each.

    Anchors are ordered by number of components, label and the signs of the first components, and numbered by parts of the
    range with counts carried over; neighbours in that order share a tree.
    """
    x = F.col("embedding")
    sketch = sum((F.when(F.try_element_at(x, F.lit(i + 1)) > 0, 1 << (7 - i)).otherwise(0) for i in range(8)), F.lit(0))
    anchors = rows.filter(F.col("vec_id") % every == 0).withColumns({"dimension": F.size(x), "sketch": sketch})
    place = ["dimension", "label", "sketch", "row"]
    dealt = anchors.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("number", F.monotonically_increasing_id())
    # A part of the range begins a tree of its own, so no numbers are carried across parts.
    part, within = F.shiftright("number", 33), F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    tree = F.shiftleft(part, 33) + F.floor(within / size)
    grouped = dealt.select("row", "label", "embedding", "dimension", tree.alias("tree"))
    return grouped.groupBy("tree", "dimension").applyInPandas(_tree, TREES)


def _passes(trees: DataFrame, pass_bytes: int) -> Iterator[list[int]]:
    """Numbers of the trees of one pass; their rows take at most ``pass_bytes``, or it is one tree."""
    sizes = trees.select("tree", "dimension", (F.octet_length("vectors") + 64 * F.size("rows")).cast("bigint").alias("bytes"))
    part, held = [], 0
    for r in sizes.orderBy("tree", "dimension").toLocalIterator():
        if part and held + r.bytes > pass_bytes:
            yield part
            part, held = [], 0
        part.append((r.tree, r.dimension))
        held += r.bytes
    if part:
        yield part


def _top(found: DataFrame, keep: int) -> DataFrame:
    best = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)


def mine(embeddings: DataFrame, every: int = EVERY, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive."""
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession, "negatives")
    rows = scratch.save(usable(embeddings), "rows", rows=BATCH)
    trees = scratch.save(planted(rows, every, TREE), "trees")
    names = rows.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")).filter(F.col("anchor_id") % every == 0)
    out = None
    for number, part in enumerate(_passes(trees, pass_bytes)):
        key = F.struct(F.lit(part[0][0]).alias("tree"), F.lit(part[0][1]).alias("dimension"))
        last = F.struct(F.lit(part[-1][0]).alias("tree"), F.lit(part[-1][1]).alias("dimension"))
        own = F.struct(F.col("tree"), F.col("dimension"))
        held = [r.asDict() for r in trees.filter((own >= key) & (own <= last)).collect()]  # at most pass_bytes
        positives = _top(rows.mapInArrow(_search(held, Positives, {}), FOUND), POSITIVES)
        positives = positives.select("anchor", (F.col("rank") - 1).alias("positive"), "vec_id", "score")
        positives = scratch.save(positives, f"positives{number}", rows=BATCH)
        scores: dict[int, list[int]] = {}
        for r in positives.orderBy("anchor", "positive").collect():  # five of each anchor of the pass
            scores.setdefault(r.anchor, []).append(r.score)
        negatives = _top(rows.mapInArrow(_search(held, Negatives, scores), FOUND), NEGATIVES)
        pairs = positives.select("anchor", "positive", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        best = negatives.select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        mined = best.join(pairs, ["anchor", "positive"]).join(names, "anchor").select(*[c.split()[0] for c in OUT.split(", ")])
        mined = scratch.save(mined, f"mined{number}", rows=BATCH)
        out = mined if out is None else out.unionByName(mined)
    return spark.createDataFrame([], OUT) if out is None else out


SQL = f"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x,
    CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id AS vec_id, a.label = c.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM rows a JOIN rows c ON a.r <> c.r AND len(a.x) = len(c.x) WHERE a.vec_id % {EVERY} = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, c) <= {POSITIVES}
), pairs AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.vec_id NULLS LAST, n.c) AS rank
  FROM positives p JOIN scored n ON p.a = n.a AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= {NEGATIVES}"""
