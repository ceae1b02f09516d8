"""Exporting and importing snapshots of a log dataset.

An export holds the lines, a table with the size and checksum of every file, and a one-row manifest. An import is staged
under a name of its own, compared with those checksums file by file, and only then made current by a version
(:mod:`logloom.sources.versions`): an import that breaks off, or whose source is damaged, leaves what was there readable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources import versions
from logloom.sources.logs import list_files, read_lines, with_path_dims

MANIFEST = "manifest"
DATA = "lines"
SUMS = "files"
COLUMNS = {"project_id", "session_id", "file", "seq", "value"}


class DamagedDataset(ValueError):
    """The lines of an export do not have the checksums it states."""


def file_sums(lines: DataFrame) -> DataFrame:
    """Lines, bytes and checksum of every file; the checksum does not depend on the order of rows, but on that of lines."""
    mark = F.xxhash64("seq", "value").cast("decimal(38,0)")
    return lines.groupBy("project_id", "file").agg(
        F.count("*").alias("line_count"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.sum(mark).cast("string").alias("checksum")
    )


def export_dataset(spark: SparkSession, root: str, target: str, exported_from: str) -> DataFrame:
    """Write all log lines (sub-agents included) by project, with checksums and a one-row manifest; returns the manifest."""
    lines = with_path_dims(read_lines(spark, root), root)
    relative = F.regexp_extract("file_path", r"projects/[^/]+/(.+)\z", 1)
    out = lines.select("project_id", "session_id", relative.alias("file"), "seq", "value")
    return write_export(out, target, exported_from)


def write_export(lines: DataFrame, target: str, exported_from: str) -> DataFrame:
    """:func:`export_dataset` of lines that are at hand: project_id, session_id, file, seq, value."""
    spark = lines.sparkSession
    # A rebalance splits big projects by size, so their number of writers follows the data.
    lines.hint("rebalance", "project_id").write.mode("overwrite").partitionBy("project_id").parquet(f"{target}/{DATA}")
    file_sums(_lines(spark, target)).write.mode("overwrite").parquet(f"{target}/{SUMS}")
    manifest = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("exported_at"), F.lit(exported_from).alias("exported_from")
    )
    manifest.coalesce(1).write.mode("overwrite").json(f"{target}/{MANIFEST}")
    return spark.read.json(f"{target}/{MANIFEST}")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a dataset; project names stay texts, even those that look like numbers."""
    return spark.read.schema("session_id string, file string, seq bigint, value string, project_id string").parquet(f"{folder}/{DATA}")


def import_dataset(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Make an exported snapshot the dataset at ``target``; returns the import manifest.

    What was there before is replaced as a whole, or, if anything fails, stays as it is.
    """
    missing = COLUMNS - set(spark.read.parquet(f"{source}/{DATA}").columns)
    if missing:
        raise ValueError(f"not an exported dataset, missing columns: {sorted(missing)}")
    before, _ = versions.latest(spark, target)
    name = uuid.uuid4().hex
    staged = f"{target}/data/{name}"
    try:
        meta = spark.read.json(f"{source}/{MANIFEST}").select("exported_at", "exported_from")
        _lines(spark, source).write.mode("errorifexists").partitionBy("project_id").parquet(f"{staged}/{DATA}")
        file_sums(_lines(spark, staged)).write.mode("errorifexists").parquet(f"{staged}/{SUMS}")
        files = spark.read.parquet(f"{staged}/{SUMS}")
        _compare(spark.read.parquet(f"{source}/{SUMS}"), files)
        top = ~F.contains("file", F.lit("/"))
        counted = files.agg(
            F.count_distinct("project_id").alias("project_count"), F.count_if(top).alias("session_count"),
            F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        )
        both = counted.unionByName(meta, allowMissingColumns=True)
        manifest = both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("imported_at", F.current_timestamp().cast("string"))
        manifest.coalesce(1).write.mode("errorifexists").json(f"{staged}/{MANIFEST}")
        versions.commit(spark, target, before, {"data": name})
    except Exception:
        versions.remove(spark, staged)
        raise
    return spark.read.json(f"{staged}/{MANIFEST}")


def _compare(stated: DataFrame, found: DataFrame) -> None:
    """Fail if a file is missing, added or changed."""
    key, value = ["project_id", "file"], ["line_count", "bytes", "checksum"]
    both = stated.select(*key, *value).join(found.select(*key, *[F.col(v).alias(f"_{v}") for v in value]), key, "full")
    same = F.lit(True)
    for v in value:
        same &= F.col(v).eqNullSafe(F.col(f"_{v}"))
    bad = both.filter(~same).select("file").limit(3).collect()
    if bad:
        raise DamagedDataset(f"lines and checksums differ, among others in {[r['file'] for r in bad]}")


def dataset_folder(spark: SparkSession, target: str, number: int | None = None) -> str:
    """Where the lines of the current import, or of that with a version number, lie."""
    content = versions.latest(spark, target)[1] if number is None else versions.read_version(spark, target, number)
    if content is None:
        raise ValueError(f"no dataset at {target}")
    return f"{target}/data/{content['data']}"


def read_dataset(spark: SparkSession, target: str, number: int | None = None) -> DataFrame:
    """Lines of an imported dataset, shaped like :func:`logs.read_lines`."""
    data = _lines(spark, dataset_folder(spark, target, number))
    path = F.concat(F.lit("projects/"), "project_id", F.lit("/"), "file")
    return data.select("value", path.alias("file_path"), "seq")


def forget_imports(spark: SparkSession, target: str, keep: int = 1) -> None:
    """Remove all but the newest ``keep`` imports."""
    for content in versions.forget(spark, target, keep):
        if content:
            versions.remove(spark, f"{target}/data/{content['data']}")


def dataset_counts(spark: SparkSession, root: str) -> DataFrame:
    """Projects, sessions, files and bytes of a live log tree."""
    return list_files(spark, root).agg(
        F.count_distinct("project_id").alias("project_count"), F.count_if("top_level").alias("session_count"),
        F.count("*").alias("file_count"), F.sum("bytes").alias("total_bytes"),
    )
