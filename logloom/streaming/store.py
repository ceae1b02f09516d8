"""Stored state of a log tree, brought up to date by what changed.

The store keeps, beside the signature of every log file, what reports need without the JSON: ``lines`` (the facts of each
record), ``turns`` with their tool counts, ``tools`` (the calls of a turn) and ``sessions`` (the summaries).
Lines, turns and tools depend on one file each, sessions on the files of one session. A refresh reads only new and changed
files, writes their rows as a *segment*, with the sessions they belong to summed up anew, and commits a version that
lists the segments (see :mod:`logloom.sources.versions`). A segment also names the files and sessions
whose older rows it replaces; these are left out of older segments by an anti join, which is a broadcast
while few files changed. Files that are gone are replaced by nothing.

A chunk stream adds lines to files instead (:func:`append_chunks`): stored lines stay, and the turns of the files concerned
are built from all of their lines by the same functions. The version remembers the last batch, so a replayed one is passed over.

Segments are merged when there are more than ``MOST_SEGMENTS``: the newest ones, as long as the one before is not
much larger, so a row is rewritten a logarithmic number of times. The driver handles segment names, and
the paths of changed files up to ``MOST_PATHS``; beyond that the tree is read whole and cut down by a join.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.operators import records as R
from logloom.operators import sessions as S
from logloom.operators import turns as TU
from logloom.plans.session_logs import dashboard_tables
from logloom.session import cut_lineage
from logloom.sources import versions
from logloom.sources.logs import list_files, parse_envelope, read_lines, with_path_dims

SESSION = ["project_id", "session_id"]
FILE = ["file_path"]
MOST_SEGMENTS = 8
MOST_PATHS = 50_000
# What a segment replaces, by table. Lines are replaced by a refresh, but not by a chunk, which adds to them.
REPLACED = {"lines": ("replaced", FILE), "turns": ("touched", FILE), "tools": ("touched", FILE), "files": ("touched", FILE), "sessions": ("resummed", SESSION)}
FILES = "file_path string, project_id string, session_id string, top_level boolean, signature string, modified_at timestamp, bytes bigint, next_seq bigint"


@dataclass
class Segment:
    name: str
    files: int
    schemas: dict[str, str] = field(default_factory=dict)


class Store:
    """One version of the stored state; ``table`` gives its rows."""

    def __init__(self, spark: SparkSession, folder: str, number: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        if number is None:
            self.number, content = versions.latest(spark, self.folder)
        else:
            self.number, content = number, versions.read_version(spark, self.folder, number)
            if content is None:
                raise ValueError(f"{folder} has no version {number}")
        content = content or {"segments": [], "batches": {}, "prices": None}
        self.segments = [Segment(**s) for s in content["segments"]]
        self.batches: dict[str, int] = content["batches"]
        self.prices: str | None = content["prices"]

    def _read(self, segment: Segment, table: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(segment.schemas[table]))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{segment.name}/{table}")

    def table(self, name: str, since: int = 0) -> DataFrame:
        """The rows of ``lines``, ``turns``, ``tools``, ``files`` or ``sessions`` in the segments from ``since`` on."""
        dead, key = REPLACED[name]
        parts = []
        for at, segment in enumerate(self.segments[since:], since):
            rows = self._read(segment, name)
            later = [self._read(s, dead) for s in self.segments[at + 1:]]
            parts.append(rows.join(_union(later).distinct(), key, "left_anti").select(rows.columns) if later else rows)
        if not parts:
            raise ValueError(f"{self.folder} is empty")
        return _union(parts)

    def write(self, segment: Segment, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("errorifexists").parquet(f"{self.folder}/segments/{segment.name}/{name}")
        segment.schemas[name] = rows.schema.json()
        return self._read(segment, name)

    def with_segments(self, segments: list[Segment]) -> Store:
        """The same state with other segments, not yet committed."""
        out = Store.__new__(Store)
        out.__dict__.update(self.__dict__, segments=segments)
        return out

    def commit(self) -> Store:
        content = {"segments": [vars(s) for s in self.segments], "batches": self.batches, "prices": self.prices}
        return Store(self.spark, self.folder, versions.commit(self.spark, self.folder, self.number, content))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _price_mark(prices: DataFrame) -> str:
    """Tells price lists apart, whatever the order of their rows."""
    row = prices.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(prices.columns)).cast("decimal(38,0)")).alias("mark")).first()
    return f"{row['n']}:{row['mark']}"


def _resummed(state: Store, segment: Segment, sessions: DataFrame, prices: DataFrame) -> None:
    """Write the summaries of ``sessions``; those without a top-level file have none."""
    own = {name: state.table(name) for name in ("lines", "turns", "tools")}
    rows = {name: df.join(sessions, SESSION, "left_semi").select(df.columns) for name, df in own.items()}
    summary = S.session_summary(R.facts_of(rows["lines"]), rows["turns"], rows["tools"], prices)
    state.write(segment, "sessions", summary)
    state.write(segment, "resummed", sessions)


def _write_turns(state: Store, segment: Segment, lines: DataFrame) -> None:
    tools = state.write(segment, "tools", TU.turn_tools(R.tool_uses_of(lines)))
    state.write(segment, "turns", TU.with_tool_counts(TU.collapse_turns(R.snapshots_of(lines)), tools))


def tree_lines(spark: SparkSession, root: str) -> Callable[[DataFrame, bool], DataFrame]:
    """Reader of the lines of some files of a log tree, for :func:`refresh`."""

    def read(files: DataFrame, everything: bool) -> DataFrame:
        paths = [] if everything else [r["file_path"] for r in files.select("file_path").limit(MOST_PATHS + 1).collect()]
        if everything or len(paths) > MOST_PATHS:
            lines = with_path_dims(read_lines(spark, root), root)
            return lines.join(files.select("file_path"), "file_path", "left_semi").select(lines.columns)
        if not paths:
            return with_path_dims(spark.createDataFrame([], "value string, file_path string, seq bigint"), root)
        return with_path_dims(read_lines(spark, root, paths=paths), root)

    return read


def refresh(spark: SparkSession, folder: str, files: DataFrame, lines_of: Callable[[DataFrame, bool], DataFrame], prices: DataFrame) -> Store:
    """Bring the store up to date with ``files`` and commit; unchanged input commits nothing.

    ``files``: file_path, signature, project_id, session_id, top_level, modified_at, bytes, as :func:`logs.list_files`
    gives them. ``lines_of(changed files, all of them?)`` gives their lines. Files are listed before they are read, so
    a file that grows meanwhile has another signature next time and is read again.
    """
    state, mark = Store(spark, folder), _price_mark(prices)
    names = [c.split(" ")[0] for c in FILES.split(", ")]
    listed = cut_lineage(files.withColumn("next_seq", F.lit(None).cast("bigint")).select(names))
    gone = None
    if state.segments:
        seen = cut_lineage(state.table("files"))
        changed = listed.join(seen.select("file_path", "signature"), ["file_path", "signature"], "left_anti").select(names)
        gone = seen.join(listed, FILE, "left_anti").select("file_path", *SESSION)
    else:
        changed = listed
    changed = cut_lineage(changed)
    touched = changed.select("file_path", *SESSION)
    touched = cut_lineage(touched if gone is None else touched.unionByName(gone))
    n_touched = touched.count()
    if not n_touched and state.segments and state.prices == mark:
        return state
    segment = Segment(uuid.uuid4().hex, n_touched)
    state.write(segment, "files", changed)
    lines = state.write(segment, "lines", R.log_facts(parse_envelope(lines_of(changed, not state.segments))))
    for name in ("touched", "replaced"):
        state.write(segment, name, touched.select("file_path"))
    _write_turns(state, segment, lines)
    after = state.with_segments([*state.segments, segment])
    everywhere = state.segments and state.prices != mark
    sessions = after.table("files").unionByName(changed).select(*SESSION).distinct() if everywhere else touched.select(*SESSION).distinct()
    _resummed(after, segment, cut_lineage(sessions), prices)
    after.prices = mark
    return merge_segments(after.commit())


def refresh_tree(spark: SparkSession, root: str, folder: str, prices: DataFrame) -> Store:
    """Bring the store of a log tree up to date; only new and changed files are read."""
    return refresh(spark, folder, list_files(spark, root), tree_lines(spark, root), prices)


def append_chunks(spark: SparkSession, folder: str, chunks: DataFrame, batch: int, prices: DataFrame, stream: str = "stream") -> Store:
    """Add a batch of chunk lines to the store and commit, once per batch number of a stream.

    ``chunks``: value, chunk_path, chunk_bytes, offset (see ``activity.read_chunk_lines``). The lines of a chunk belong to the log
    file of the same path below ``projects``; chunks of one file follow each other in the order of their paths.
    """
    state = Store(spark, folder)
    if state.batches.get(stream, -1) >= batch:
        return state
    path = F.concat(F.lit("projects/"), F.regexp_extract("chunk_path", r"(?:\A|/)projects/(.*)\z", 1))
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    read = chunks.select("value", path.alias("file_path"), "chunk_path", "chunk_bytes", (F.col("offset") * 2 + index).alias("at"))
    read = cut_lineage(with_path_dims(read))
    parts = read.groupBy("file_path", *SESSION, "top_level", "chunk_path").agg(F.max("chunk_bytes").alias("size"))
    before = Window.partitionBy("file_path").orderBy("chunk_path").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum(F.col("size") * 2 + 2).over(before), F.lit(0)))
    files = parts.groupBy("file_path", *SESSION, "top_level").agg(F.sum("size").alias("bytes"), F.sum(F.col("size") * 2 + 2).alias("room"))
    old = state.table("files").select("file_path", F.col("bytes").alias("_bytes"), F.col("next_seq").alias("_next")) if state.segments else None
    old = spark.createDataFrame([], "file_path string, _bytes bigint, _next bigint") if old is None else old
    files = cut_lineage(files.join(old, FILE, "left").withColumn("base", F.coalesce("_next", F.col("_bytes") * 2 + 2, F.lit(0))))
    place = parts.select("file_path", "chunk_path", "before").join(files.select("file_path", "base"), FILE)
    lines = read.join(place, ["file_path", "chunk_path"]).withColumn("seq", F.col("at") + F.col("before") + F.col("base"))
    lines = lines.select("value", "file_path", "seq", *SESSION, "top_level")
    segment = Segment(uuid.uuid4().hex, files.count())
    state.write(segment, "lines", R.log_facts(parse_envelope(lines)))
    state.write(segment, "files", files.select(
        "file_path", *SESSION, "top_level", F.lit(f"{stream}:{batch}").alias("signature"), F.lit(None).cast("timestamp").alias("modified_at"),
        (F.col("bytes") + F.coalesce("_bytes", F.lit(0))).alias("bytes"), (F.col("base") + F.col("room")).alias("next_seq"),
    ))
    touched = state.write(segment, "touched", files.select("file_path"))
    state.write(segment, "replaced", touched.limit(0))
    after = state.with_segments([*state.segments, segment])
    stored = after.table("lines")
    _write_turns(state, segment, cut_lineage(stored.join(touched, FILE, "left_semi").select(stored.columns)))
    _resummed(after, segment, cut_lineage(files.select(*SESSION).distinct()), prices)
    after.batches, after.prices = {**state.batches, stream: batch}, after.prices or _price_mark(prices)
    return merge_segments(after.commit())


def merge_segments(state: Store, most: int = MOST_SEGMENTS) -> Store:
    """Merge the newest segments into one and commit, if there are more than ``most``."""
    if len(state.segments) <= most:
        return state
    first, held = len(state.segments) - 1, state.segments[-1].files
    while first > 0 and (first >= most or state.segments[first - 1].files <= 2 * held):
        first -= 1
        held += state.segments[first].files
    segment = Segment(uuid.uuid4().hex, held)
    for name in REPLACED:
        state.write(segment, name, state.table(name, first))
    for name in ("touched", "replaced", "resummed"):
        state.write(segment, name, _union([state._read(s, name) for s in state.segments[first:]]).distinct())
    return state.with_segments([*state.segments[:first], segment]).commit()


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Remove all but the newest ``keep`` versions and the segments that only removed ones list."""
    gone = {s["name"] for v in versions.forget(spark, folder, keep) for s in v.get("segments", [])}
    kept = set()
    number, _ = versions.latest(spark, folder)
    for n in range(max(1, number - keep), number + 1):
        kept |= {s["name"] for s in (versions.read_version(spark, folder, n) or {}).get("segments", [])}
    for name in gone - kept:
        versions.remove(spark, f"{folder}/segments/{name}")


def stored_dashboard(spark: SparkSession, folder: str, prices: DataFrame, base: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All dashboard tables (see :func:`session_logs.dashboard`) from the store, without reading a log."""
    state = Store(spark, folder)
    return dashboard_tables(R.facts_of(state.table("lines")), state.table("turns"), state.table("tools"), state.table("sessions"), state.table("files"), prices, base)
