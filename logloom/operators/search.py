"""Text search that skips the parts of a text table which cannot hold the words.

The texts are written in parts of a bounded size, by session, as folders of one partition column, together with a sketch of
each part: a bit set of the three-byte sequences in its lower-cased texts. A text that contains the words contains all their
three-byte sequences, so parts without one of these bits are skipped; the rest is read and tested exactly. Skipping is a
semi join on the partition column with the sketches, which the optimizer turns into partition pruning at run time. Words of
fewer than three bytes skip nothing.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.operators.sessions import KEY, search_sessions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_BYTES = 32 << 20
BITS = 1 << 18
GRAM = 3
SKETCHES = "part int, words array<bigint>"


def gram_bits(raw: bytes) -> np.ndarray:
    """Bit numbers of the three-byte sequences of a text."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.zeros(0, np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B1)) % np.uint64(BITS)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task: one bit set per part in it, of 64-bit words."""
    flags: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            bits = flags.setdefault(part, np.zeros(BITS, bool))
            bits[gram_bits(text.as_buffer().to_pybytes())] = True
    for part, bits in flags.items():
        words = np.packbits(bits, bitorder="little").view("<i8")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([words.tolist()], pa.list_(pa.int64()))], names=["part", "words"])


def build_text_index(texts: DataFrame, folder: str, part_bytes: int = PART_BYTES) -> None:
    """Write ``texts`` (session key and ``text``) in parts with their sketches.

    Parts are ranges of the session key; rows of one session are spread by their text, so a session of any size fills many.
    """
    spark = texts.sparkSession
    keys = [c for c in KEY if c in texts.columns]
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [*keys, F.xxhash64("text")]
    placed = texts.filter("text is not null").repartitionByRange(max(1, -(-size // part_bytes)), *order)
    placed = placed.withColumn("part", F.spark_partition_id())
    # An empty table leaves no file that tells its columns.
    spark.createDataFrame([(placed.schema.json(),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/schema")
    placed.write.mode("errorifexists").partitionBy("part").parquet(f"{folder}/texts")
    written = _texts(spark, folder)
    found = written.select("part", F.lower("text").alias("text")).mapInArrow(_sketch, SKETCHES)
    # A part that several tasks read has a bit set from each; any of them may hold a bit.
    found.write.mode("errorifexists").parquet(f"{folder}/sketches")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(spark.read.text(f"{folder}/schema").first()["value"]))
    return spark.read.schema(schema).parquet(f"{folder}/texts")


def candidate_parts(spark: SparkSession, folder: str, words: str) -> DataFrame:
    """The numbers of the parts that may contain ``words``."""
    sketches = spark.read.schema(SKETCHES).parquet(f"{folder}/sketches")
    needed = sorted({b // 64 for b in gram_bits(words.lower().encode()).tolist()})
    if not needed:
        return sketches.select("part").distinct()
    # Only the words of the bit set that matter are merged.
    some = sketches.select("part", *[F.get("words", F.lit(w)).alias(f"w{w}") for w in needed])
    merged = some.groupBy("part").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in needed])
    bits = sorted(set(gram_bits(words.lower().encode()).tolist()))
    held = F.lit(True)
    for w in needed:
        mask = sum(1 << (b % 64) for b in bits if b // 64 == w)
        mask = mask - (1 << 64) if mask >> 63 else mask
        held &= F.col(f"w{w}").bitwiseAND(F.lit(mask)) == mask
    return merged.filter(held).select("part")


def search_report(spark: SparkSession, folder: str, words: str) -> DataFrame:
    """One row: parts of the index, and those that a search for ``words`` skips."""
    parts = spark.read.schema(SKETCHES).parquet(f"{folder}/sketches").agg(F.count_distinct("part").alias("parts"))
    read = candidate_parts(spark, folder, words).agg(F.count("*").alias("read"))
    both = parts.unionByName(read, allowMissingColumns=True).agg(F.max("parts").alias("parts"), F.max("read").alias("read"))
    return both.select("parts", (F.col("parts") - F.col("read")).alias("skipped"))


def search_index(spark: SparkSession, folder: str, sessions: DataFrame, words: str, limit: int | None = 50) -> DataFrame:
    """:func:`sessions.search_sessions` over an index: the same rows, reading only parts that may hold the words."""
    if not words.strip():
        return search_sessions(_texts(spark, folder), sessions, words, limit)
    texts = _texts(spark, folder).join(F.broadcast(candidate_parts(spark, folder, words)), "part", "left_semi")
    return search_sessions(texts, sessions, words, limit)
