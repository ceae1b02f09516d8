"""Live activity counts over a landing folder of immutable log chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import non_empty
from logloom.operators.records import turn_key
from logloom.sources.logs import parse_envelope, with_path_dims
from logloom.streaming.store import append_chunks

CHUNK_SCHEMA = "value string"


def read_chunks(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of log lines; chunks keep the project and session folders of the live tree."""
    reader = spark.readStream.schema(CHUNK_SCHEMA).format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select("value", F.col("_metadata.file_path").alias("file_path"), F.lit(0).cast("bigint").alias("seq"))


def read_chunk_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of log lines with their chunk and the place of their split in it, for :func:`store_stream`."""
    reader = spark.readStream.schema(CHUNK_SCHEMA).format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    meta = F.col("_metadata")
    return reader.load(folder).select(
        "value", meta["file_path"].alias("chunk_path"), meta["file_size"].alias("chunk_bytes"), meta["file_block_start"].alias("offset")
    )


def store_stream(chunks: DataFrame, folder: str, checkpoint: str, prices: DataFrame, name: str = "stream"):
    """Add all chunks that are there to a store and stop. A batch that is run again after a failure changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        append_chunks(batch.sparkSession, folder, batch, number, prices, name)

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_activity(lines: DataFrame, lateness: str = "2 hours", window: str = "1 day") -> DataFrame:
    """Turns per time window. Repeated snapshots of a turn count once; late ones beyond the bound are dropped."""
    records = parse_envelope(with_path_dims(lines)).filter("type = 'assistant'")
    events = records.select(
        "project_id", "session_id", turn_key().alias("turn_key"), non_empty(F.col("timestamp")).try_cast("timestamp").alias("at")
    ).filter("at is not null")
    once = events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["project_id", "session_id", "turn_key"])
    counts = once.groupBy(F.window("at", window)).agg(F.count("*").alias("turn_count"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "turn_count")


def run_once(stream: DataFrame, target: str, checkpoint: str):
    """Process what is there and stop; closed windows are appended to ``target``."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )
