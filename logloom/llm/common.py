"""Shared staging, hashing and word helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BATCH = 256
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of one Arrow batch while a job runs: few where a row may hold a long text."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local tests that name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Written tables of one operator call in the shared folder.

    A saved table cuts the lineage: a lost executor costs the running stage only. ``drop`` removes
    tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, rows: int = ROWS_PER_BATCH, **options: str) -> DataFrame:
        with arrow_rows(self.spark, rows):
            df.write.options(**options).mode("errorifexists").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks_for(n_bytes: int, per_task: int, least: int = 1) -> int:
    """Tasks so that one handles about ``per_task`` bytes."""
    return max(least, -(-n_bytes // per_task))


def number_copies(rows: DataFrame, key: list[str], part: str = "part", name: str = "nth") -> DataFrame:
    """Number the rows of every key from 0 in ``name``; NULL keys count as equal.

    ``rows`` is a written table and ``part`` any column that spreads a frequent key over tasks. Rows are numbered inside
    (key, part), and what earlier parts of a key hold is carried over, so no task sees a whole key. ``part`` is dropped.
    """
    counts = rows.groupBy(*key, part).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).filter("_before > 0")
    carried = carried.select(*[F.col(c).alias(f"_of_{c}") for c in [*key, part]], "_before")
    inside = Window.partitionBy(*key, part).orderBy(F.lit(0))
    numbered = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    same = F.col(part) == F.col(f"_of_{part}")
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    number = (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("bigint")
    return numbered.join(carried, same, "left").select(*[c for c in rows.columns if c != part], number.alias(name))


def row_digest(df: DataFrame, seed: int = 0) -> Column:
    """A 64-bit hash of all columns of a row, whatever their types; equal rows have equal ones."""
    parts = []
    for field in df.schema:
        kind, value = field.dataType.simpleString(), F.col(f"`{field.name}`")
        plain = not any(k in kind for k in ("map<", "variant"))
        parts += [value if plain else F.to_json(F.struct(value)), value.isNull()]
    return F.xxhash64(*parts, F.lit(seed))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def utf8(text: str | None) -> bytes:
    """Bytes of a text, none for NULL."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser with full avalanche."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
