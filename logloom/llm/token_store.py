"""Token ids as raw binary shards with a minimal perfect hash index for keyed access.

A shard is two files in a shared folder: ``<name>.bin`` holds nothing but ids, little-endian, two bytes
each (four for vocabularies over 65,536), document after document in ascending doc_id order; ``<name>.idx``
holds the index. The index is a cascade of bit arrays: on each level every remaining key hashes to a bit,
keys alone on their bit are settled there and the rest go to the next level. The rank of a key's bit is its
slot, so n keys own exactly n slots. A slot stores a 32-bit fingerprint of its key, so that foreign keys are
turned away, and the first document of that key. A lookup costs a few probes whatever the shard's size.

Files carry random names and count only once Spark commits the manifest that names them, so a task that
is run twice leaves an unused file and never a wrong one.

Edge cases: a NULL text is empty and yields the end id alone; rows with one doc_id (NULL included) are kept
side by side, ordered by text (by its first 64 characters where they fill several shards), and are told apart by ``copy``; NULL ids come first; an empty table gives
no shard; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import Scratch, mix64, tasks_for
from logloom.llm.tokens import default_vocabulary, encoder, ids_crc32

MAGIC = b"TOKSHRD1"
NULL_KEY = -(1 << 63)
LEVELS = 64
GAMMA = 2
MANIFEST = "doc_id bigint, copy bigint, shard int, file string, n_ids bigint"
READ_ROWS = 4096
SHARD_BYTES = 32 << 20
BEGINNING = 64


def _level_hash(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mix64(keys ^ seed) % np.uint64(bits)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.concatenate([[0], np.cumsum(bits)]) for bits in levels]
        self.rank = counts
        self.base = np.concatenate([[0], np.cumsum([c[-1] for c in counts])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            size = 64 * -(-GAMMA * len(rest) // 64)
            at = _level_hash(rest, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a foreign key any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        for level, bits in enumerate(self.levels):
            at = _level_hash(keys, level, len(bits))
            hit = (out < 0) & bits[at]
            out[hit] = self.base[level] + self.rank[level][at[hit]]
        return out


def write_index(keys: np.ndarray, first: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """Index of a shard. keys: distinct; first: each key's first document; offsets: of documents, in ids."""
    unsigned = keys.astype(np.int64).view(np.uint64)
    hashed = PerfectHash.build(unsigned)
    slot = hashed.slots(unsigned)
    prints, starts = np.zeros(len(keys), np.uint32), np.zeros(len(keys) + 1, np.int64)
    prints[slot], starts[slot] = _fingerprint(unsigned), first
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<IIQQ", width, len(hashed.levels), len(keys), len(offsets) - 1))
    for bits in hashed.levels:
        out.write(struct.pack("<Q", len(bits)) + np.packbits(bits).tobytes())
    for part, kind in ((prints, "<u4"), (starts[:-1], "<i8"), (offsets, "<i8")):
        out.write(part.astype(kind).tobytes())
    return out.getvalue()


class Shard:
    """An opened shard: ``find`` gives documents, ``read`` their ids."""

    def __init__(self, path: str):
        files, base = pafs.FileSystem.from_uri(path)
        with files.open_input_stream(base + ".idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        width, levels, keys, docs = struct.unpack_from("<IIQQ", raw, 8)
        at, bits = 32, []
        for _ in range(levels):
            (size,) = struct.unpack_from("<Q", raw, at)
            at += 8
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        self.hashed = PerfectHash(bits)
        self.prints = np.frombuffer(raw, "<u4", keys, at)
        self.first = np.frombuffer(raw, "<i8", keys, at + 4 * keys)
        self.offsets = np.frombuffer(raw, "<i8", docs + 1, at + 12 * keys)
        self.dtype = np.dtype(f"<u{width}")
        self.payload = files.open_input_file(base + ".bin")

    def find(self, keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Numbers of the documents with these keys and copies, -1 where the shard has no such key or not so many of it."""
        unsigned = keys.astype(np.int64).view(np.uint64)
        slot = self.hashed.slots(unsigned)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == _fingerprint(unsigned[found])
        out = np.full(len(keys), -1, np.int64)
        begins, ends = self.first[slot[found]], np.append(np.sort(self.first), len(self.offsets) - 1)
        docs = begins + copies[found]
        # The documents of a key end where those of the next one begin.
        out[found] = np.where(docs < ends[np.searchsorted(ends, begins, "right")], docs, -1)
        return out

    def read(self, docs: np.ndarray) -> list[np.ndarray]:
        """Ids of documents in ascending order; neighbours are read together."""
        if not len(docs):
            return []
        width, out = self.dtype.itemsize, []
        for part in np.split(docs, np.flatnonzero(np.diff(docs) > 1) + 1):
            low, high = int(self.offsets[part[0]]), int(self.offsets[part[-1] + 1])
            raw = np.frombuffer(self.payload.read_at((high - low) * width, low * width), self.dtype)
            out += [raw[self.offsets[d] - low:self.offsets[d + 1] - low] for d in part.tolist()]
        return out


def _writer(folder: str, vocabulary: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        name = f"{folder}/shard-{task:06d}-{uuid.uuid4().hex}"
        files, base = pafs.FileSystem.from_uri(name)
        keys, absent, lengths, payload = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if payload is None:
                files.create_dir(base.rsplit("/", 1)[0], recursive=True)
                payload = files.open_output_stream(base + ".bin")
            ids = encode(batch.column(1).to_pylist())
            payload.write(np.concatenate(ids).tobytes())
            keys.append(batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
            absent.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            lengths.append(np.array([len(x) for x in ids], np.int64))
        if payload is None:
            return
        payload.close()
        key, length = np.concatenate(keys), np.concatenate(lengths)
        distinct, first = np.unique(key, return_index=True)
        offsets = np.concatenate([[0], np.cumsum(length)])
        with files.open_output_stream(base + ".idx") as f:
            f.write(write_index(distinct, first, offsets, encoder(vocabulary).dtype.itemsize))
        copy = np.arange(len(key)) - first[np.searchsorted(distinct, key)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(key, mask=np.concatenate(absent)), "copy": pa.array(copy),
            "shard": pa.array(np.full(len(key), task, np.int32)), "file": pa.array([name] * len(key)),
            "n_ids": pa.array(length),
        })

    return write


def write_tokens(docs: DataFrame, scratch: Scratch, vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all texts as token shards; returns the manifest: a row per document with its shard's file.

    The texts are dealt once into ranges of about ``shard_bytes`` of text, of which each becomes a shard; their number grows with
    the texts. Ranges go by doc_id, then by the beginning of the text and the place of the row, so a doc_id, or no id, that
    stands on a third of all rows, or one row that does, fills many shards.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    begins = F.coalesce(F.substring("text", 1, BEGINNING), F.lit(""))
    ordered = (
        texts.withColumns({"begins": begins, "place": F.monotonically_increasing_id()})
        .repartitionByRange(tasks_for(size, shard_bytes), "doc_id", "begins", "place").sortWithinPartitions("doc_id", "text")
    )
    rows = ordered.select("doc_id", "text").mapInArrow(_writer(f"{scratch.path}/shards", vocabulary or default_vocabulary()), MANIFEST)
    return scratch.save(rows, "manifest")


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by file; each is found in it by key and copy."""
    shard, opened = None, None
    for batch in batches:
        files = batch.column("file").to_pylist()
        cuts = [i for i in range(batch.num_rows) if not i or files[i] != files[i - 1]] + [batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if files[low] != opened:
                shard, opened = Shard(files[low]), files[low]
            rows = batch.slice(low, high - low)
            docs = shard.find(rows.column("doc_id").fill_null(NULL_KEY).to_numpy(zero_copy_only=False), rows.column("copy").to_numpy())
            if (docs < 0).any():
                raise ValueError(f"{opened} lacks a key that its manifest names")
            ids = shard.read(docs)
            made = [pa.array(shard.offsets[docs], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([ids_crc32(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("shard"), *made], names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Look every key of the manifest up in its shard: doc_id, start, n_tokens, ids_crc32.

    Only narrow manifest rows are shuffled. The running start is a window over one row per shard.
    """
    keyed = manifest.select("file", "doc_id", "copy", "shard")
    # A task per shard: the manifest's own small size says nothing about the payload that its rows read.
    shards = manifest.agg(F.coalesce(F.max("shard") + 1, F.lit(1))).first()[0]
    found = keyed.repartition(shards, "file").sortWithinPartitions("file", "doc_id", "copy").mapInArrow(
        _lookup, "doc_id bigint, shard int, place bigint, n_tokens bigint, ids_crc32 bigint"
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode, write, and read every document back by key."""
    scratch = Scratch(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, scratch, vocabulary)
    return scratch.save(read_tokens(manifest), "read", rows=READ_ROWS)
