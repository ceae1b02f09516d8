"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into full pieces; the first piece takes the remainder. Pieces are
dealt by hash into problems of about ``PROBLEM_ITEMS`` pieces. Each problem is worked on by several islands,
which are rows of a table: an island evolves a few packings from its own random seed, and after every epoch
each island hands its best packing to its neighbour through a join. A crossover copies a tenth of the
sequences of one parent, best filled first by chance, into the other, dissolves the sequences that now hold a
piece twice, and places the displaced pieces by best fit, longest first. The best packing of a problem wins.
Only lengths travel through the evolution; the pieces are read again to take their places.

Every problem has a bounded number of pieces, whatever key, source or copy is frequent, as pieces are dealt
by doc_id, piece and their place in the task that cut them. At most the last sequence of a problem is
loosely filled, so the loss against one common problem is below one sequence in some thousands.

Edge cases: a NULL or empty text is a document of the end id alone; repeated rows are packed as often as
they occur; an empty table gives an empty result; other columns are ignored. Reruns on the same files agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Scratch, tasks_for
from logloom.llm.tokens import default_vocabulary, encoder, ids_crc32

CAPACITY = 2048
PROBLEM_ITEMS = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 4, 4
ISLANDS_PER_TASK = 8
INJECTED_SHARE = 0.1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint"
_ORDER = ["length", "doc_id", "piece", "ids_crc32", "nth"]


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of a document of ``n`` ids."""
    if n <= capacity:
        return [0]
    first = n % capacity
    return ([0] if first else []) + list(range(first, n, capacity))


def _cutter(vocabulary: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, encode = 0, encoder(vocabulary).encode
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                starts = cut_points(len(ids), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((key, k, a, b - a, ids_crc32(ids[a:b]), nth))
                nth += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [()] * 6
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return cut


class _Bins:
    """Open sequences by free space; a bit per free space that occurs finds the best fit."""

    def __init__(self, free: list[int]):
        self.free, self.at, self.bits = free, {}, 0
        for b, room in enumerate(free):
            self._put(b, room)

    def _put(self, b: int, room: int) -> None:
        if room:
            self.at.setdefault(room, []).append(b)
            self.bits |= 1 << room

    def place(self, length: int, capacity: int) -> int:
        fits = self.bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            stack = self.at[room]
            b = stack.pop()
            if not stack:
                del self.at[room]
                self.bits ^= 1 << room
        else:
            b, room = len(self.free), capacity
            self.free.append(capacity)
        self.free[b] = room - length
        self._put(b, room - length)
        return b


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int, into: np.ndarray | None = None, free: list[int] | None = None) -> np.ndarray:
    """Place the items ``order`` one by one into the fullest sequence with room; fills and returns ``into``."""
    into = np.full(len(lengths), -1, np.int32) if into is None else into
    bins, sizes = _Bins(free or []), lengths.tolist()
    for i in order.tolist():
        into[i] = bins.place(sizes[i], capacity)
    return into


def fitness(lengths: np.ndarray, packing: np.ndarray, capacity: int) -> tuple[int, float]:
    """Few sequences first, then unevenly filled ones, which leave room to gain; larger is better."""
    fill = np.bincount(packing, lengths)
    return -len(fill), float(np.mean((fill / capacity) ** 2))


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled sequences of ``b`` into ``a`` and best-fit what they displace."""
    fill = np.bincount(b, lengths)
    wanted = max(1, int(len(fill) * INJECTED_SHARE))
    chosen = np.argsort(-fill * rng.uniform(0.9, 1.0, len(fill)), kind="stable")[:wanted]
    marked = np.zeros(len(fill), bool)
    marked[chosen] = True
    injected = marked[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True
    kept = ~injected & ~broken[a]
    displaced = np.flatnonzero(~injected & broken[a])
    child = np.full(len(a), -1, np.int32)
    left, child_left = np.unique(a[kept], return_inverse=True)
    child[kept] = child_left
    fresh, child_new = np.unique(b[injected], return_inverse=True)
    child[injected] = child_new + len(left)
    done = child >= 0
    free = (capacity - np.bincount(child[done], lengths[done], minlength=len(left) + len(fresh))).astype(int).tolist()
    return best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], capacity, child, free)


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS) -> np.ndarray:
    """Run one epoch on one island and return its best packing."""
    rng = np.random.default_rng(seed)
    people = list(elites)
    if not people:
        people = [best_fit(lengths, np.argsort(-lengths, kind="stable"), capacity)]
    while len(people) < POPULATION:
        people.append(best_fit(lengths, np.argsort(-lengths * rng.uniform(0.85, 1.0, len(lengths))), capacity))
    rank = lambda p: fitness(lengths, p, capacity)
    least = -(-int(lengths.sum()) // capacity)
    for _ in range(generations):
        people.sort(key=rank, reverse=True)
        if -rank(people[0])[0] <= least:
            break
        half = people[: POPULATION // 2]
        children = []
        for k in range(POPULATION - len(half)):
            a, b = half[k % len(half)], people[int(rng.integers(len(people)))]
            children.append(crossover(lengths, a, b, capacity, rng))
        people = half + children
    return max(people, key=rank)


def _lengths(rows: pd.DataFrame) -> pd.DataFrame:
    ordered = np.sort(rows["length"].to_numpy())
    return pd.DataFrame({"problem": [rows["problem"].iloc[0]], "lengths": [ordered.astype("<i4").tobytes()]})


def _epoch(capacity: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, "<i4").astype(np.int64)
                elites = [np.frombuffer(x, "<i4").astype(np.int32) for x in (row.own, row.migrant) if x is not None]
                best = evolve(lengths, elites, capacity, seed=row.problem * 1009 + row.island * 31 + epoch)
                n, shape = fitness(lengths, best, capacity)
                out.append((row.problem, row.island, row.lengths, best.astype("<i4").tobytes(), n + shape / 2))
            yield pd.DataFrame(out, columns=["problem", "island", "lengths", "own", "score"])

    return run


def _place(pieces: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values(_ORDER, kind="stable", na_position="first").reset_index(drop=True)
    bins = np.frombuffer(best["own"].iloc[0], "<i4").astype(np.int64)
    lengths = pieces["length"].to_numpy()
    by_bin = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[by_bin])
    first = np.concatenate([[True], np.diff(bins[by_bin]) > 0])
    before = ends - lengths[by_bin]
    offset = np.empty(len(bins), np.int64)
    offset[by_bin] = before - np.maximum.accumulate(np.where(first, before, 0))
    pieces["sequence_id"] = pieces["problem"].to_numpy() * (1 << 32) + bins
    pieces["offset"] = offset
    return pieces[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    cut = texts.mapInArrow(_cutter(vocabulary or default_vocabulary(), capacity), PIECES)
    pieces = scratch.save(cut, "pieces")
    problems = tasks_for(pieces.count(), PROBLEM_ITEMS)
    tasks = tasks_for(problems * ISLANDS, ISLANDS_PER_TASK)
    dealt = pieces.withColumn("problem", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth"), F.lit(problems)))
    lengths = dealt.select("problem", "length").groupBy("problem").applyInPandas(_lengths, "problem bigint, lengths binary")
    nothing = F.lit(None).cast("binary")
    islands = (
        lengths.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        .withColumns({"own": nothing, "migrant": nothing}).repartition(tasks, "problem", "island")
    )
    state = None
    for epoch in range(EPOCHS):
        evolved = islands.mapInPandas(
            _epoch(capacity, epoch), "problem bigint, island int, lengths binary, own binary, score double"
        )
        state = scratch.save(evolved, f"epoch{epoch}", rows=4)
        moved = state.select(
            "problem", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.col("own").alias("migrant")
        )
        islands = state.drop("score").join(moved, ["problem", "island"]).repartition(tasks, "problem", "island")
    best = state.groupBy("problem").agg(F.max_by("own", F.struct("score", -F.col("island"))).alias("own"))
    placed = dealt.groupBy("problem").cogroup(best.groupBy("problem")).applyInPandas(
        _place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
    return scratch.save(placed, "placed", rows=10_000)
