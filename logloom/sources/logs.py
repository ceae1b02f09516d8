"""Session logs: JSON lines under ``<root>/projects``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import variants as V
from logloom.functions.text import group_or_null, non_blank

# Envelope fields with a declared type; a wrong type (also null) drops the record.
STRING_FIELDS = {
    "type": "type", "uuid": "uuid", "timestamp": "timestamp", "sessionId": "own_session_id", "cwd": "cwd",
    "gitBranch": "git_branch", "version": "version", "sourceToolAssistantUUID": "source_uuid",
}
OBJECT_FIELDS = {
    "message": "message", "attachment": "attachment", "compactMetadata": "compact_metadata",
    "microcompactMetadata": "microcompact_metadata", "toolUseResult": "tool_use_result",
}
# Below the projects folder: a session's own log, and the logs of its sub-agents.
TOP_FILE = r"\A([^/]+)/([^/]+)\.jsonl\z"
# Long tool outputs and inline images make long strings. Deeper nesting than this is rejected, as parsing is recursive.
JSON_BOUNDS = {"maxStringLen": str((1 << 31) - 1), "maxNumLen": "100000", "maxNestingDepth": "3000"}
SUB_FILE = r"\A([^/]+)/([^/]+)/subagents/.+\.jsonl\z"


def _plain_path() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, root: str, modified_after: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """Every line of every log file, or of those in ``paths``, with its file and place.

    ``seq`` orders the lines of a file without a shuffle: twice the byte offset of the split plus the
    row's index in its task. A task reads at most one split's worth of bytes and a line takes at
    least one byte, so the numbers of one split stay below those of the next.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # Names are taken as they are, not as patterns.
    chosen = f"{root}/projects" if paths is None else [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
    return reader.text(chosen).select(
        "value", _plain_path().alias("file_path"),
        (F.col("_metadata.file_block_start") * 2 + index).alias("seq"),
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per log file: dimensions, size and change time (``signature`` = both)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
        .load(f"{root}/projects")
        .select(
            _plain_path().alias("file_path"),
            F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"),
        )
    )
    signature = F.concat_ws(":", F.unix_millis("modified_at"), "bytes")
    return with_path_dims(files, root).withColumn("signature", signature)


def with_path_dims(df: DataFrame, root: str | None = None) -> DataFrame:
    """Project, session and top-level flag from the path; sub-agent files belong to their session.

    The project folder is the one below ``<root>/projects``, without a root the one below the first ``projects``.
    """
    path = F.col("file_path")
    if root is not None:
        folder = re.sub(r"\A[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "", root).strip("/")
        inside = F.instr(path, F.lit(f"{folder}/projects/"))
        path = F.when(inside > 0, F.substring(path, inside + F.lit(len(folder) + 1), F.length(path))).otherwise(path)
    path = F.regexp_extract(path, r"(?:\A|/)projects/(.*)\z", 1)
    top = path.rlike(TOP_FILE)
    project = F.coalesce(group_or_null(path, TOP_FILE, 1), group_or_null(path, SUB_FILE, 1))
    session = F.coalesce(group_or_null(path, TOP_FILE, 2), group_or_null(path, SUB_FILE, 2))
    return df.withColumns({"project_id": project, "session_id": session, "top_level": top}).filter("session_id is not null")


def _json(text: Column) -> Column:
    """A JSON text as VARIANT, NULL where it is none."""
    return F.from_json(text, "variant", JSON_BOUNDS)


def _parsed(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their ``record``, NULL where the line is no JSON."""
    other = [c for c in lines.columns if c not in ("value",)]
    # The generator keeps the optimizer from pushing the checks below the parse, which would repeat
    # the parse once per check.
    return lines.filter(non_blank(F.col("value"))).select(
        *other, F.col("value").alias("line"), F.explode(F.array(_json(F.col("value")))).alias("record")
    )


def _well_typed(record: Column) -> Column:
    """Whether a record is an object whose declared fields have their types."""

    def scalar(name: str, kind: str) -> Column:
        return F.coalesce(V.kind_at(record, name) == kind, F.lit(True))

    valid = F.coalesce(V.is_object(record), F.lit(False)) & scalar("isMeta", "BOOLEAN")
    for name in STRING_FIELDS:
        valid = valid & scalar(name, "STRING")
    for name in OBJECT_FIELDS:
        valid = valid & (V.get(record, name, "struct<>").isNotNull() | V.get(record, name).isNull())
    return valid


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The non-blank lines that :func:`parse_envelope` leaves out: their place, size in bytes and the reason."""
    other = [c for c in lines.columns if c not in ("value",)]
    reason = F.when(F.col("record").isNull(), "unparsable").otherwise("wrong type")
    bad = _parsed(lines).filter(~F.coalesce(_well_typed(F.col("record")), F.lit(False)))
    return bad.select(*other, F.octet_length("line").alias("bytes"), reason.alias("reason"))


def parse_envelope(lines: DataFrame) -> DataFrame:
    """Typed envelope of each line; blank, unparsable and wrongly typed lines are dropped (see :func:`rejected_lines`)."""
    other = [c for c in lines.columns if c not in ("value",)]
    record = F.col("record")
    return _parsed(lines).filter(_well_typed(record)).select(
        *other,
        *[V.get(record, n, "string").alias(c) for n, c in STRING_FIELDS.items()],
        V.get(record, "isMeta", "boolean").alias("is_meta"),
        *[V.get(record, n).alias(c) for n, c in OBJECT_FIELDS.items()],
        "record", "line",
    )


def read_records(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """Parsed records of a log tree with path dimensions and line order."""
    return parse_envelope(with_path_dims(read_lines(spark, root, modified_after), root))


def parse_history(lines: DataFrame) -> DataFrame:
    """Prompt history rows (``value`` = one JSON line); malformed lines are skipped."""
    record = _json(F.col("value"))
    rows = lines.filter(F.col("value") != "").select(record.alias("record")).filter(V.is_object(F.col("record")))
    r = F.col("record")
    return rows.select(
        V.get(r, "display", "string").alias("display"), V.get(r, "project", "string").alias("project"),
        F.timestamp_millis(V.number_at(r, "timestamp")).alias("at"), V.get(r, "pastedContents").alias("pasted"),
    )


def read_history(spark: SparkSession, root: str) -> DataFrame:
    return parse_history(spark.read.text(f"{root}/history.jsonl"))


def read_rollup_base(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Long tables of ``stats-cache.json``: activity, daily_models, models, hours, totals."""
    doc = spark.read.text(f"{root}/stats-cache.json", wholetext=True).select(_json(F.col("value")).alias("v"))
    v = F.col("v")

    def rows(path: str) -> DataFrame:
        return doc.select(F.explode(V.items(V.get(v, path))).alias("r"))

    def pairs(df: DataFrame, source: Column, *keep: Column) -> DataFrame:
        return df.select(*keep, F.explode(V.fields(source)).alias("name", "r"))

    r = F.col("r")
    number = lambda name: V.number_at(r, name)
    activity = rows("dailyActivity").select(
        V.get(r, "date", "string").alias("date"), number("messageCount").alias("message_count"),
        number("sessionCount").alias("session_count"), number("toolCallCount").alias("tool_call_count"),
    )
    days = rows("dailyModelTokens").select(V.get(r, "date", "string").alias("date"), V.get(r, "tokensByModel").alias("by_model"))
    whole = F.try_variant_get(r, "$", "double").cast("bigint")
    return {
        "activity": activity,
        "daily_models": pairs(days, F.col("by_model"), F.col("date")).select("date", F.col("name").alias("model"), whole.alias("tokens")),
        "models": pairs(doc, V.get(v, "modelUsage")).select(
            F.col("name").alias("model"), number("inputTokens").alias("input_tokens"), number("outputTokens").alias("output_tokens"),
            number("cacheCreationInputTokens").alias("cache_write_tokens"), number("cacheReadInputTokens").alias("cache_read_tokens"),
        ),
        "hours": pairs(doc, V.get(v, "hourCounts")).select(F.col("name").try_cast("int").alias("hour"), whole.alias("turn_count")),
        "totals": doc.select(
            V.get(v, "lastComputedDate", "string").alias("last_date"), V.number_at(v, "totalSessions").alias("session_count"),
            V.number_at(v, "totalMessages").alias("message_count"), V.get(v, "firstSessionDate", "string").alias("first_session_date"),
            V.get(v, "longestSession.sessionId", "string").alias("longest_session_id"),
            V.number_at(v, "longestSession.duration").alias("longest_duration_ms"),
            V.number_at(v, "longestSession.messageCount").alias("longest_message_count"),
        ),
    }
