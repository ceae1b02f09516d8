"""Numbered versions of a folder: what belongs to a version becomes visible by one small file.

Data is written first, to names of its own; then ``commit`` creates ``versions/<number>`` with the description of what is
current, as the only step that readers can see. The file is created without overwriting, so of two writers with one number
one fails, and its last line tells whether it is whole: a writer that dies before or in the commit leaves
the version before in place. Works on every file system that Spark writes to.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

FOLDER = "versions"
END = "\nend\n"


class VersionTaken(RuntimeError):
    """Another writer has committed this number."""


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    path, fs = _path(spark, f"{folder}/{FOLDER}")
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return sorted(int(n) for n in names if re.fullmatch(r"\d+", n))


def read_version(spark: SparkSession, folder: str, number: int) -> dict | None:
    """The description of a version, None where its file is missing or not whole."""
    path, fs = _path(spark, f"{folder}/{FOLDER}/{number}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text.removesuffix(END)) if text.endswith(END) else None


def latest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """Number and description of the newest whole version; (0, None) in a new folder."""
    for number in reversed(_numbers(spark, folder)):
        content = read_version(spark, folder, number)
        if content is not None:
            return number, content
    return 0, None


def commit(spark: SparkSession, folder: str, after: int, content: dict) -> int:
    """Make ``content`` current, if ``after`` still is the newest version; returns the new number."""
    if latest(spark, folder)[0] != after:
        raise VersionTaken(f"version {after} of {folder} is no longer the newest")
    number = max([after, *_numbers(spark, folder)]) + 1
    path, fs = _path(spark, f"{folder}/{FOLDER}/{number}")
    try:
        stream = fs.create(path, False)
    except Exception as error:
        raise VersionTaken(f"version {number} of {folder} exists") from error
    stream.write((json.dumps(content) + END).encode())
    stream.close()
    return number


def remove(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def forget(spark: SparkSession, folder: str, keep: int) -> list[dict]:
    """Remove all but the newest ``keep`` descriptions; returns the removed ones."""
    gone = []
    for number in _numbers(spark, folder)[:-keep]:
        gone.append(read_version(spark, folder, number) or {})
        remove(spark, f"{folder}/{FOLDER}/{number}")
    return gone
