"""Texts in chunks, and the exchange of sorted runs between chunks and buckets.

Repeated passages are found without moving texts: documents are written once as chunks of a few megabytes;
every chunk sends, per bucket of a key space, one sorted run of short keys; a bucket merges the runs of all
chunks and answers each with a few bits per key; the answers are joined back to the chunks. A key, however
frequent, travels once per chunk. All sizes follow the data: chunks and buckets are bounded, their number grows.

Both numbers grow with the corpus, so a row for each pair of chunk and bucket would be the square of it. Runs
travel in packets instead, in as many hops as the buckets need: no sender has more than ``FAN`` addresses, and
what a panel of senders has for one range of buckets is put together and cut up for the next hop. Rows per hop
are at most ``FAN`` times the chunks; answers go back the same way.

Memory of a worker does not follow the corpus: rows come in batches of bounded bytes and are looked at in place, runs
are merged a stretch of keys at a time (``stretches``), and what a chunk or a group took goes back to the system.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logloom.llm.common import ROWS_PER_BATCH, Scratch, mix64, tasks_for, utf8

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
# Answers up to this size are broadcast to the chunks; larger ones are joined by a shuffle.
BROADCAST_BYTES = 48 << 20
CHUNK_ROWS = 2
# Bytes from which on a batch of packets goes to a worker, and rows that are merged at once.
BATCH_BYTES = 4 << 20
STRETCH_ROWS = 1 << 17
# A row of chunks may take megabytes: readers hold few of them, and pages are cut by size from the first row on.
READ_ROWS = 4
PAGES = {"compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
# The most addresses of a sender in one hop. A hop moves all runs once more, so they should be few: two reach 16 million
# buckets, some 250 TB of text, and packets of a chunk stay at a few hundred bytes.
FAN = 4096
LAST_ID = (1 << 63) - 1
CHUNKS = "chunk bigint, n_docs bigint, n_bytes bigint, n_words bigint, doc_ids binary, nulls binary, sizes binary, texts binary, carry binary"
PACKETS = "toward bigint, panel bigint, packet binary"


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(scratch: Scratch, df: DataFrame, name: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Write what is made from chunks or packets; their rows are read and sent to workers a few megabytes at a time."""
    limits = {"spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    with _settings(scratch.spark, **limits):
        return scratch.save(df, name, rows=rows)


def give_back() -> None:
    """Return free memory to the system; a worker would keep it for as long as it lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _gather(chunk_bytes: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, others, held, fields = [], [], [], 0, None

        def row() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            carried = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*others), fields)], schema=pa.schema(fields))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, carried.schema) as stream:
                stream.write_batch(carried)
            values = [
                number, len(texts), int(sizes.sum()), sum(len(t.split()) for t in texts),
                np.array([LAST_ID if i is None else i for i in ids], np.int64).tobytes(), np.packbits([i is None for i in ids]).tobytes(),
                sizes.tobytes(), b"".join(texts), sink.getvalue().to_pybytes(),
            ]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 5
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        for batch in batches:
            fields = list(batch.schema)[2:]
            columns = [c.to_pylist() for c in batch.columns]
            rest = zip(*columns[2:]) if fields else [()] * batch.num_rows
            for key, text, other in zip(columns[0], columns[1], rest):
                raw = utf8(text)
                if texts and held + len(raw) > chunk_bytes:
                    yield row()
                    ids, texts, others, held, number = [], [], [], 0, number + 1
                ids.append(key)
                texts.append(raw)
                others.append(other)
                held += len(raw)
        if texts:
            yield row()

    return gather


def stage_chunks(docs: DataFrame, scratch: Scratch, carry: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the texts as chunks. A NULL doc_id ranks as ``LAST_ID``, the largest there is, and comes back as NULL.

    ``carry`` names further columns; they stay with their documents.
    """
    texts = docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *[F.col(c).alias(f"in_{c}") for c in carry or []]
    )
    return scratch.save(texts.mapInArrow(_gather(chunk_bytes), CHUNKS), "chunks", **PAGES)


def bucket_count(chunks: DataFrame) -> int:
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return tasks_for(total, BUCKET_BYTES)


class Chunk:
    """One chunk row with its arrays; ``answers`` maps a bucket to the bytes it returned."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(self.doc_ids)).astype(bool)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.raw, self._carry = row["texts"], row["carry"]
        self.answers = {
            name: {b: part for p in row[name] or [] for b, _, part in frames(p)} for name in row if name.startswith("answers")
        }

    def ids(self) -> list[int | None]:
        """The doc_ids as they were given."""
        return [None if empty else i for i, empty in zip(self.doc_ids.tolist(), self.nulls.tolist())]

    def carried(self) -> dict:
        """The further columns of the documents."""
        with pa.ipc.open_stream(self._carry) as stream:
            batch = stream.read_next_batch()
        return dict(zip(batch.schema.names, batch.columns))

    def texts(self) -> Iterator[bytes]:
        for end, size in zip(self.ends.tolist(), self.sizes.tolist()):
            yield bytes(self.raw[end - size:end])


def _in_place(value: pa.Scalar):
    """A value of a batch; bytes as a view of the batch."""
    if not value.is_valid:
        return None
    if isinstance(value, pa.BinaryScalar):
        return memoryview(value.as_buffer())
    return [_in_place(v) for v in value] if isinstance(value, pa.ListScalar) else value.as_py()


def _over_chunks(make: Callable[[Chunk], Iterator[dict]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: _in_place(column[k]) for name, column in zip(batch.schema.names, batch.columns)}
                for columns in make(Chunk(row)):
                    yield pa.RecordBatch.from_pydict(columns, schema=schema)
                    del columns
                give_back()

    return run


def over_chunks(chunks: DataFrame, make: Callable[[Chunk], Iterator[dict]], schema: str) -> DataFrame:
    """Apply ``make``, which yields columns of rows, to every chunk."""
    return chunks.mapInArrow(_over_chunks(make, to_arrow_schema(StructType.fromDDL(schema))), schema)


def pack(frames: list[tuple[int, int, bytes]]) -> bytes:
    """A packet of frames: (bucket, chunk, bytes)."""
    numbers = np.array([(b, c, len(part)) for b, c, part in frames], np.int64).T
    return b"".join([np.int64(len(frames)).tobytes(), numbers.tobytes(), *[part for _, _, part in frames]])


def frames(packet: bytes) -> Iterator[tuple[int, int, memoryview]]:
    """The frames of a packet, their bytes as views of it."""
    view = memoryview(packet)
    n = int(np.frombuffer(packet, np.int64, 1)[0])
    numbers, at = np.frombuffer(packet, np.int64, 3 * n, 8).reshape(3, n), 8 + 24 * n
    for bucket, chunk, size in numbers.T.tolist():
        yield bucket, chunk, view[at:at + size]
        at += size


class Routes:
    """The hops of an exchange between ``chunks`` senders and ``buckets``.

    A bucket's number is read in digits to the base ``fan``, the highest first, one digit a hop. Chunks are dealt by hash
    into panels of about ``fan``, panels into panels of panels. Runs for one range of buckets meet per panel.
    """

    def __init__(self, buckets: int, chunks: int):
        self.buckets, self.chunks, self.hops = buckets, chunks, 1
        while FAN ** self.hops < buckets:
            self.hops += 1
        self.fan = 2
        while self.fan ** self.hops < buckets:
            self.fan += 1
        self.panels = tasks_for(chunks, self.fan)

    def toward(self, bucket: int, hop: int) -> int:
        """The range of buckets to which a run for ``bucket`` comes by this hop; the bucket itself by the last."""
        return bucket // self.fan ** (self.hops - hop)

    def panel(self, chunk: int, level: int) -> int:
        """The panel of a chunk; itself at level 0."""
        if level == 0:
            return chunk
        return int(mix64(np.array([chunk], np.uint64))[0] % np.uint64(self.panels)) // self.fan ** (level - 1)

    def tasks(self, level: int) -> int:
        """Tasks of a hop out of panels of this level: a task handles several groups one after another once there are many."""
        groups = self.fan ** level * tasks_for(self.panels, self.fan ** (level - 1))
        return max(min(groups, 1024), groups // 16)


def _packets(found: Iterable[tuple[int, int, bytes]], address: Callable[[int, int], tuple[int, int]]) -> Iterator[dict]:
    """Rows of packets: the frames by the (toward, panel) that ``address`` gives for a bucket and chunk.

    ``found`` is in order of its addresses. Rows are handed on at every ``BATCH_BYTES``.
    """
    rows, held = {"toward": [], "panel": [], "packet": []}, 0
    for (toward, panel), part in groupby(found, key=lambda f: address(f[0], f[1])):
        packet = pack(list(part))
        for name, value in zip(rows, (toward, panel, packet)):
            rows[name].append(value)
        held += len(packet)
        if held >= BATCH_BYTES:
            yield rows
            rows, held = {"toward": [], "panel": [], "packet": []}, 0
    if held:
        yield rows


def _first_hop(send: Callable[[Chunk], Iterator[dict]], routes: Routes):
    def hop(chunk: Chunk) -> Iterator[dict]:
        panel = routes.panel(chunk.number, min(1, routes.hops - 1))
        yield from _packets(((b, chunk.number, run) for b, run in send(chunk)), lambda b, _: (routes.toward(b, 1), panel))

    return hop


_PACKETS = pa.schema([("toward", pa.int64()), ("panel", pa.int64()), ("packet", pa.binary())])


def _frames_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, memoryview]]:
    for batch in batches:
        for packet in batch.column("packet"):
            yield from frames(_in_place(packet))


def _further_hop(address: Callable[[int, int], tuple[int, int]]):
    def hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(_frames_of(batches), key=lambda f: address(f[0], f[1]))
        for columns in _packets(found, address):
            yield pa.RecordBatch.from_pydict(columns, schema=_PACKETS)
        del found
        give_back()

    return hop


def exchange(
    chunks: DataFrame, scratch: Scratch, name: str, routes: Routes,
    send: Callable[[Chunk], Iterator[tuple[int, bytes]]], merge: Callable[[list[bytes], np.ndarray], list[bytes]],
) -> DataFrame:
    """Send runs to buckets, merge them there, and return packets of answers by chunk (``panel``).

    ``send`` yields (bucket, run), buckets ascending. ``merge`` gets the runs of one bucket with their chunk numbers, in chunk order, and
    answers each.
    """
    last = routes.hops - 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(_frames_of(batches), key=lambda f: f[1])
        answers = merge([run for _, _, run in found], np.array([c for _, c, _ in found], np.int64))
        replies = [(b, c, reply) for (b, c, _), reply in zip(found, answers)]
        del found, answers
        home = lambda b, c: (routes.toward(b, max(1, last)), routes.panel(c, last))
        for columns in _packets(sorted(replies, key=lambda f: home(f[0], f[1])), home):
            yield pa.RecordBatch.from_pydict(columns, schema=_PACKETS)
        del replies
        give_back()

    moved = over_chunks(chunks, _first_hop(send, routes), PACKETS)
    for hop in range(2, routes.hops + 1):
        ahead = _further_hop(lambda b, c, hop=hop: (routes.toward(b, hop), routes.panel(c, min(hop, last))))
        moved = moved.repartition(routes.tasks(hop - 1), "toward", "panel").groupBy("toward", "panel").applyInArrow(ahead, PACKETS)
    merged = moved.repartition(max(min(routes.buckets, 1024), routes.buckets // 16), "toward").groupBy("toward").applyInArrow(answer, PACKETS)
    replies = save(scratch, merged, name if last == 0 else f"{name}-merged", rows=ROWS_PER_BATCH)
    if last == 0:
        return replies
    for level in range(last, 0, -1):
        home = _further_hop(lambda b, c, level=level: (routes.toward(b, max(1, level - 1)), routes.panel(c, level - 1)))
        replies = replies.repartition(routes.tasks(level), "toward", "panel").groupBy("toward", "panel").applyInArrow(home, PACKETS)
    replies = save(scratch, replies, name, rows=ROWS_PER_BATCH)
    scratch.drop(f"{name}-merged")
    return replies


def with_answers(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Join the answers to their chunks as ``name``; they are broadcast only up to a measured size."""
    size = answers.agg(F.sum(F.octet_length("packet") + 64)).first()[0] or 0
    grouped = answers.groupBy(F.col("panel").alias("chunk")).agg(F.collect_list("packet").alias(name))
    return chunks.join(F.broadcast(grouped) if size <= BROADCAST_BYTES else grouped, "chunk", "left")


def split_runs(buckets_of: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each stretch of an ascending bucket array."""
    if not len(buckets_of):
        return []
    cuts = np.flatnonzero(np.diff(buckets_of)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(buckets_of)]])
    return [(int(buckets_of[s]), int(s), int(e)) for s, e in zip(starts, ends)]


def stretches(runs: list[np.ndarray]) -> Iterator[list[tuple[int, int]]]:
    """Cut ascending runs of hashes alike, at some ``STRETCH_ROWS`` rows of all: start and end in every run.

    Equal values never part. Hashes spread evenly, so equal ranges of values hold about as many.
    """
    least = min((int(r[0]) for r in runs if len(r)), default=0)
    most = max((int(r[-1]) for r in runs if len(r)), default=0)
    parts = tasks_for(sum(map(len, runs)), STRETCH_ROWS)
    bounds = [least + (most - least) * k // parts for k in range(1, parts)]
    cuts = [[0, *np.searchsorted(r, np.array(bounds, r.dtype)).tolist(), len(r)] for r in runs]
    for k in range(parts):
        yield [(cut[k], cut[k + 1]) for cut in cuts]


def range_bucket(high32: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of a 32-bit hash: ascending hashes give ascending buckets."""
    return ((high32.astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
