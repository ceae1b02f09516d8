"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record's slot is a hash of its key, its text and its number among equal records over 4,096 slots and never changes,
so records that share one key, or have none, are dealt over the slots like all others. A small table maps slots to shards, one
version after the other, each written to the shared folder. The first version deals slots round; a rebalancing
reads the bytes per slot and edits the map: it moves single slots from the heaviest shard to the lightest, always
the slot that comes nearest to half their difference, until no move narrows the gap. So sizes come out near
equal while few records change their shard.

Equal records are numbered by input part, with the counts of earlier parts added, so no task holds all copies of one.
The table is read for a record's size, key and text hash only; slot loads are summed before the shuffle; the map has a fixed
number of rows, which bounds what reaches the driver and what is broadcast. Row numbers inside a shard
are the rows of earlier slots plus a window inside one slot, so no task holds a shard.

Edge cases: a NULL text has size 1; a NULL key is hashed like any other; equal records are interchangeable; an empty
table gives no rows and a map that deals slots round; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.common import Scratch

SLOTS = 4096
SHARDS = 8
_MAP = "version int, virtual_slot int, shard int"


class SlotMap:
    """Versions of a slot-to-shard map in a folder."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots
        self.version = self.taken = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SlotMap:
        """The map that an earlier run left in ``path``, at its last whole version, to be read or edited further."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
        numbers = {int(p.getName().removeprefix("version=")): p for p in names if p.getName().startswith("version=")}
        # A version counts once its write is committed; the number of one that never was stays unused.
        whole = [n for n, p in numbers.items() if files.exists(p.suffix("/_SUCCESS"))]
        if not whole:
            raise ValueError(f"no slot map at {path}")
        found = cls(spark, path)
        found.version, found.taken = max(whole), max(numbers)
        found.slots = found.table().count()
        return found

    def store(self, shards: list[int]) -> None:
        """Write the next version; a map has one entry per slot."""
        self.version = self.taken = max(self.version, self.taken) + 1
        rows = [(self.version, slot, shard) for slot, shard in enumerate(shards)]
        self.spark.createDataFrame(rows, _MAP).coalesce(1).write.parquet(f"{self.path}/version={self.version}")

    def table(self, version: int | None = None) -> DataFrame:
        """(virtual_slot, shard) of a version, the last if none is named."""
        chosen = self.version if version is None else version
        return self.spark.read.schema(_MAP).parquet(f"{self.path}/version={chosen}").select("virtual_slot", "shard")


def edit_map(shards: list[int], loads: dict[int, int], n_shards: int) -> list[int]:
    """Move slots from the heaviest to the lightest shard while that narrows the gap."""
    shards = list(shards)
    held = [[s for s, shard in enumerate(shards) if shard == k and loads.get(s)] for k in range(n_shards)]
    total = [sum(loads[s] for s in slots) for slots in held]
    while True:
        heavy, light = max(range(n_shards), key=total.__getitem__), min(range(n_shards), key=total.__getitem__)
        gap = total[heavy] - total[light]
        best = min(held[heavy], key=lambda s: (abs(2 * loads[s] - gap), s), default=None)
        if best is None or loads[best] >= gap:
            return shards
        shards[best] = light
        held[heavy].remove(best)
        held[light].append(best)
        total[heavy] -= loads[best]
        total[light] += loads[best]


def slotted(docs: DataFrame, scratch: Scratch, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every record."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    read = docs.select(
        F.col("doc_id").cast("bigint"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("text_hash"), F.spark_partition_id().alias("part"),
    )
    read = scratch.save(read, "read")
    key = ["doc_id", "text_hash"]
    counts = read.groupBy(*key, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter("before > 0")
    before = before.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.col("part").alias("of_part"), "before")
    numbered = read.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "part").orderBy("size")) - 1)
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")) & (F.col("part") == F.col("of_part"))
    number = F.col("nth") + F.coalesce("before", F.lit(0))
    return numbered.join(before, same, "left").select(
        "doc_id", "size", "text_crc32", F.pmod(F.xxhash64(*key, number.cast("bigint")), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def rebalance(records: DataFrame, slot_map: SlotMap, shards: int) -> None:
    """Store the next version of the map, edited for the bytes per slot."""
    loads = {r.virtual_slot: r.load for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("load")).collect()}
    current = [r.shard for r in slot_map.table().orderBy("virtual_slot").collect()]
    slot_map.store(edit_map(current, loads, shards))


def shard_records(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard and its place there: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    slot_map = SlotMap(spark, f"{scratch.path}/map", slots)
    slot_map.store([s % shards for s in range(slots)])
    records = scratch.save(slotted(docs, scratch, slots), "records")
    rebalance(records, slot_map, shards)
    counts = records.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(slot_map.table(), "virtual_slot", "right")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("nth", F.row_number().over(inside) - 1).join(F.broadcast(base), "virtual_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
