"""A training-data pipeline: quality rules, near-dedup, substring dedup, mixing and packing of ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet
and read again. All but the last return the columns of documents. ``n_chars`` follows a shortened text.

Near-dedup tells rows apart by doc_id and text, so repeated rows, rows that share a doc_id and rows without one are
reduced like all others; blank texts are like nothing and stay. A stage on an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import minhash, mixing, packing, quality, suffix_dedup
from logloom.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rules or the line labels reject."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return judged.filter("kept").select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every near-duplicate group."""
    return minhash.first_of_groups(docs)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the passages that an earlier document holds; documents of which nothing is left go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = suffix_dedup.remove_repeats(docs, carry=others, texts=True)
    left = cut.filter("n_removed < n_bytes OR n_bytes = 0")
    made = {"n_chars": F.length("text").cast("bigint")} | {c: F.col(f"in_{c}") for c in others}
    return left.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw sources to their target weights; a document stands as often as it is drawn."""
    return mixing.mixed_documents(docs, shard=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules), ("minhash near-dedup", near_dedup), ("suffix-array dedup", repeats_removed),
    ("mixing sources", mixed), ("best-fit packing", packed),
]
# Line labelling, random mixing and genetic packing have no SQL form; the tests hold every stage to its rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
