"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: sources share the corpus size by weight; a target stops at three times its source, and what is above
   is shared anew by weight until none is. Filled like a vessel: sources ordered by size per weight stop one
   after the other, and one window over the sources finds the level at which the rest settles.
2. Blocks: a source's documents are dealt by hash into blocks, and the blocks are permuted by hash. The mix draws
   every block as often as the source fits whole into its target, and once more the first permuted blocks up to
   the rest. Of the block in which the target ends, documents are drawn until the target is met.
3. Tree: the exact number of block draws of every source is split between the two halves of the output shards by a
   multivariate hypergeometric draw, and so on down to single shards. A source's permuted draws are then handed
   out in stretches, so shards are disjoint, and a shard is shuffled by a hash of its rows.

Only per-source totals (one row per entry of the mix) reach the driver; windows run over sources and over the
blocks of a source. A source with a third of all rows has as many times more blocks: the number of documents of a block
and the number of blocks both grow with the root of a large source.

Repeated rows are numbered, and the number goes into their place in mixed order, so a row that stands a third of the
time is dealt over all blocks. ``mixed_documents`` tells rows apart by doc_id, source and a hash of all
columns; one text under two sources is drawn for each by its own plan. Rows equal in all columns are written from one of them.

Edge cases: NULL source is a source of its own, last; a NULL or blank text has size 0, is drawn with its block and adds
nothing; repeated rows are drawn separately; an empty source has target 0; an empty table gives no rows. Columns of any
name and type are handed through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import Scratch, number_copies, row_digest, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SHARDS = 8
BLOCK_DOCS = 512
# Keys of repeated rows up to this number are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
SEED = 20_011
_DRAWN = "doc_id bigint, source string, size bigint, digest bigint, place bigint, source_size bigint, target double, block int, position bigint, whole int, extra boolean, room double"


def targets(stats: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """Add weight and target to (source, source_size, ...)."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights)).cast("int") + 1)
    table = stats.withColumn("weight", weight.cast("double")).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    table = table.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    table = table.withColumn("level", (F.sum("source_size").over(everything) - stopped) / left)
    settled = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("cap"), F.coalesce(settled * F.col("weight"), F.col("cap")))
    return table.withColumn("target", target).drop("cap", "ratio", "level")


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Draws of every source in every shard: rows are sources, columns shards; exact in both sums."""

    def split(counts: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        if high - low == 1:
            return [counts]
        middle = (low + high) // 2
        total = int(counts.sum())
        wanted = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(counts, wanted, method="marginals") if total else counts
        return split(left, low, middle) + split(counts - left, middle, high)

    return np.stack(split(np.array(quotas, np.int64), 0, shards), axis=1)


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Draw documents of the last block in mixed order while they fit; then the smallest if that comes nearer."""
    rows = rows.sort_values(["place", "doc_id", "size"]).reset_index(drop=True)
    left, sizes = float(rows["room"].iloc[0]), rows["size"].to_numpy()
    taken = np.zeros(len(rows), bool)
    for i, size in enumerate(sizes.tolist()):
        if size <= left:
            taken[i], left = True, left - size
    over = np.flatnonzero(~taken)
    if len(over) and sizes[over].min() - left < left:
        taken[over[sizes[over].argmin()]] = True
    rows["extra"] = taken
    return rows


def mixer_of(seed: int) -> Column:
    """The place of a document in mixed order, from its id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.lit(seed))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, digest: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, shards (one entry per draw), digest, place.

    ``taken`` words are size times the number of draws. Shards are shuffled inside by ``place``, which comes from id, text
    and the number among rows equal in these and the source. ``digest`` sets the order of such rows and is handed through.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    read = scratch.save(docs.select(
        F.col("doc_id").cast("bigint"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"),
        mixer_of(seed).alias("mixer"), (F.lit(0).cast("bigint") if digest is None else digest).alias("digest"), F.spark_partition_id().alias("task"),
    ), "read")
    place = F.when(F.col("nth") > 0, F.xxhash64("mixer", "nth")).otherwise(F.col("mixer"))
    parted = read.select("doc_id", "source", "size", "mixer", "digest", F.struct("digest", "task").alias("part"))
    sized = number_copies(parted, ["doc_id", "source", "mixer"]).withColumn("place", place).drop("nth", "mixer")
    sized = scratch.save(sized, "sized")
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    blocks_of = F.ceil(F.col("docs") / F.greatest(F.lit(BLOCK_DOCS), F.ceil(F.sqrt("docs")))).cast("int")
    sources = targets(stats).withColumn("blocks", blocks_of).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    )
    sources = scratch.save(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")

    def by_source(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        same = left["source"].eqNullSafe(right["_source"])
        for name in more:
            right = right.withColumnRenamed(name, f"_{name}")
            same &= left[name] == right[f"_{name}"]
        return left.join(right, same).drop("_source", *[f"_{n}" for n in more])

    placed = by_source(sized, sources.select("source", "source_size", "target", "blocks"))
    placed = placed.withColumn("block", F.pmod("place", F.col("blocks")).cast("int")).drop("blocks")
    blocks = by_source(
        placed.groupBy("source", "block").agg(F.sum("size").alias("words")), sources.select("source", "whole", "rest")
    )
    mixed = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed)), "block")
    upto = F.sum("words").over(mixed.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.withColumns({"position": (F.row_number().over(mixed) - 1).cast("bigint"), "upto": upto})
    before = F.col("upto") - F.col("words")
    blocks = scratch.save(blocks.select(
        "source", "block", "position", "whole", (F.col("upto") <= F.col("rest")).alias("extra"),
        F.when((F.col("upto") > F.col("rest")) & (before <= F.col("rest")), F.col("rest") - before).alias("room"),
    ), "blocks")
    drawn = F.col("whole") + F.when(F.col("extra") | F.col("room").isNotNull(), 1).otherwise(0)
    quotas = blocks.groupBy("source").agg(F.sum(drawn).alias("quota"), F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    cuts = np.cumsum(split_tree([r.quota for r in quotas], shards, seed), axis=1) if quotas else []
    plan = spark.createDataFrame(
        [(r.source, r.n, c.tolist()) for r, c in zip(quotas, cuts)], "source string, n bigint, cuts array<bigint>"
    )
    rows = by_source(placed, blocks, "block").select(*[c.split()[0] for c in _DRAWN.split(", ")])
    filled = rows.filter("room IS NOT NULL").groupBy("source", "block").applyInPandas(_fill, _DRAWN)
    rows = by_source(rows.filter("room IS NULL").unionByName(filled), plan)
    passes = F.sequence(F.lit(0), F.col("whole") + F.col("extra").cast("int") - 1)
    shard = lambda turn: F.size(F.filter("cuts", lambda cut: cut <= turn * F.col("n") + F.col("position")))
    # The last pass holds fewer blocks, but its positions come first in mixed order.
    chosen = F.when(F.col("whole") + F.col("extra").cast("int") > 0, F.transform(passes, shard)).otherwise(F.array().cast("array<int>"))
    return scratch.save(rows.select(
        "doc_id", "source", "size", "source_size", "target", chosen.alias("shards"), "digest", "place"
    ), "mixed")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, shard: str | None = "_shard") -> DataFrame:
    """The documents of the mix, as often as drawn, each shard shuffled inside; ``shard`` names a column for its number.

    A row meets its draws by doc_id, source and a hash of all its columns. Where rows are equal in all
    of these, one stands for all, so draws of a frequent row are joined to a single one and can be split.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    digest = row_digest(docs, seed)
    key = ["id", "of", "digest"]
    drawn = mix(docs, shards, seed, digest).select(F.col("doc_id").alias("id"), F.col("source").alias("of"), "digest", "place", "shards")
    # The documents travel as one column, so theirs cannot clash with those made here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("source").cast("string").alias("of"), digest.alias("digest"), row)
    often = scratch.save(drawn.groupBy(*key).count().filter("count > 1").select(*key), "often")
    n_often = often.count()
    if n_often:
        often = F.broadcast(often) if n_often <= BROADCAST_KEYS else often
        one = _same(keyed, often, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
        keyed = _same(keyed, often, "left_anti").unionByName(one)
    both = _same(keyed, drawn.filter(F.size("shards") > 0), "inner")
    copies = both.select("row", "place", F.posexplode("shards").alias("turn", "shard"))
    copies = copies.select("row", "shard", F.xxhash64("place", "turn", F.lit(seed)).alias("at"))
    ordered = copies.repartitionByRange("shard", "at").sortWithinPartitions("shard", "at")
    return ordered.select("row.*", *([F.col("shard").alias(shard)] if shard else []))


def _same(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join on id, source and digest, NULL equal to NULL; the key of ``rows`` stays."""
    key = ["id", "of", "digest"]
    right = keys.withColumnsRenamed({c: f"{c}_" for c in key})
    same = F.col("id").eqNullSafe(F.col("id_")) & F.col("of").eqNullSafe(F.col("of_")) & (F.col("digest") == F.col("digest_"))
    return rows.join(right, same, how).drop(*[f"{c}_" for c in key])
