"""Files in context: mentions, line ranges, coverage and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import variants as V
from logloom.functions.details import TOOL_ID_KEYS, details_preferred
from logloom.functions.text import basename, is_bare_name, is_likely_path, parse_line_count, trim_space
from logloom.operators.scans import LINE_SPAN, chunk_of, chunk_scan, running_sum

SESSION = ["project_id", "session_id"]
# Detail keys of a mentioned file, in order of preference.
PATH_KEYS = ["content.file.filePath", "filePath", "file_path", "path", "displayPath", "filename"]
LOADED_KEYS = ["content.file.numLines", "numLines"]
TOTAL_KEYS = ["content.file.totalLines", "totalLines"]
LINE_KEYS = {"start": ["startLine"], "end": ["endLine"]}
TOKENS_PER_LINE = 4
LINE_CHUNK = 1 << 20


def build_range(start: Column, end: Column, loaded: Column) -> Column:
    """struct(start, end): a missing side comes from the loaded count, swapped sides are put right."""
    loaded = F.when(loaded > 0, loaded)
    a = F.coalesce(start, F.when(end.isNotNull(), end - loaded + 1))
    b = F.coalesce(end, F.when(start.isNotNull(), start + loaded - 1))
    low = F.greatest(F.lit(1), F.least(a, b))
    high = F.greatest(low, a, b)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(low.cast("bigint").alias("start"), high.cast("bigint").alias("end")))


def read_calls(tool_calls: DataFrame) -> DataFrame:
    """File, start and end line of every Read call."""
    d = details_preferred(F.col("details"), {"path": PATH_KEYS, **LINE_KEYS})
    rows = V.computed_once(tool_calls.filter("tool_name = 'Read'"), *SESSION, "seq", "pos", "tool_id", d.alias("d"))
    return rows.select(
        *SESSION, "seq", "pos", "tool_id", "d.path", parse_line_count(F.col("d.start")).alias("start_line"), parse_line_count(F.col("d.end")).alias("end_line"),
    )


def block_mentions(blocks: DataFrame) -> DataFrame:
    """File, counts and own line numbers of every block that names a file."""
    names = {"tool_id": TOOL_ID_KEYS, "path": PATH_KEYS, "loaded": LOADED_KEYS, "total": TOTAL_KEYS, **LINE_KEYS}
    d = details_preferred(F.col("details"), names)
    has_content = F.col("content").isNotNull().alias("has_content")
    rows = V.computed_once(blocks, *SESSION, "seq", "pos", d.alias("d"), "attached", has_content)
    return rows.filter("d.path is not null").select(
        *SESSION, "seq", "pos", "d.tool_id", "d.path", "d.loaded", "d.total",
        parse_line_count(F.col("d.start")).alias("start_line"), parse_line_count(F.col("d.end")).alias("end_line"), "attached", "has_content",
    )


def resolve_ranges(mentions: DataFrame, reads: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Add ``start`` and ``end`` to block mentions: own lines, else those of the Read call they answer.

    ``mentions``: keys, tool_id, start_line, end_line, loaded_count, total_count. ``reads``: keys, seq,
    pos, tool_id, start_line, end_line (last call of an id wins). Mentions without an id are spread
    over tasks by their position instead of meeting on the NULL key.
    """
    last = reads.groupBy(*keys, "tool_id").agg(
        F.max_by(F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end")), F.struct("seq", "pos")).alias("read")
    )
    left = mentions.withColumn("_id", F.coalesce("tool_id", F.concat(F.lit("\x00"), F.col("seq").cast("string"))))
    joined = left.join(last.withColumnRenamed("tool_id", "_id"), [*keys, "_id"], "left")
    own = build_range(
        F.coalesce("start_line", "read.start"), F.coalesce("end_line", "read.end"), F.col("loaded_count")
    )
    whole = F.when(
        F.col("read").isNotNull() & F.col("loaded_count").isNotNull() & F.col("total_count").isNotNull(),
        F.struct(F.lit(1).cast("bigint").alias("start"), F.least("loaded_count", "total_count").cast("bigint").alias("end")),
    )
    out = joined.withColumn("_range", F.coalesce(own, whole))
    return out.withColumns({"start": F.col("_range.start"), "end": F.col("_range.end")}).drop("_id", "read", "_range")


def file_mentions(tool_calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every mention of a file: Read calls (referenced) and result or attachment blocks."""
    reads = read_calls(tool_calls)
    span = build_range(F.col("start_line"), F.col("end_line"), F.lit(None).cast("bigint"))
    none = F.lit(None).cast("bigint")
    referenced = reads.withColumn("_r", span).select(
        *SESSION, "seq", F.lit(0).alias("kind_order"), "pos", "path", F.lit(False).alias("in_context"), F.lit(False).alias("attached"),
        none.alias("loaded_count"), none.alias("total_count"), F.col("_r.start").alias("start"), F.col("_r.end").alias("end"),
    )
    found = block_mentions(blocks).withColumns(
        {"loaded_count": parse_line_count(F.col("loaded")), "total_count": parse_line_count(F.col("total"))}
    )
    in_context = F.col("attached") | F.col("has_content") | F.col("loaded").isNotNull() | F.col("total").isNotNull()
    shown = resolve_ranges(found, reads).select(
        *SESSION, "seq", F.lit(1).alias("kind_order"), "pos", "path", in_context.alias("in_context"), "attached",
        "loaded_count", "total_count", "start", "end",
    )
    both = referenced.unionByName(shown)
    clean = trim_space(F.regexp_replace("path", r"\r?\n", " "))
    return both.withColumn("path", clean).filter(is_likely_path(F.col("path")))


def context_files(mentions: DataFrame) -> DataFrame:
    """One row per file: a bare name joins the earliest full path of that name in its session.

    Paths compare without case. Mentions are reduced to one row per path before anything is joined.
    """
    at = F.struct("seq", "kind_order", "pos")
    per_path = mentions.withColumn("path_key", F.lower("path")).groupBy(*SESSION, "path_key").agg(
        F.min(at).alias("first_at"), F.min_by("path", at).alias("path"), F.bool_or("in_context").alias("in_context"),
        F.bool_or("attached").alias("attached"), F.max("loaded_count").alias("loaded_count"),
        F.max("total_count").alias("total_count"), F.count("*").alias("mentions"),
    )
    per_path = per_path.withColumns({"base": F.lower(basename(F.col("path"))), "bare": is_bare_name(F.col("path"))})
    home = per_path.filter("not bare").groupBy(*SESSION, "base").agg(F.min_by("path_key", "first_at").alias("home"))
    placed = per_path.join(home, [*SESSION, "base"], "left").withColumn(
        "file_key", F.when(F.col("bare"), F.coalesce("home", "path_key")).otherwise(F.col("path_key"))
    )
    full_first = F.struct("bare", "first_at")
    is_home = F.coalesce(F.col("file_key") == F.col("home"), F.lit(False))
    return placed.groupBy(*SESSION, "file_key").agg(
        F.min_by("path", full_first).alias("full_path"), F.bool_or("in_context").alias("in_context"),
        F.bool_or("attached").alias("attached"), F.min("first_at")["seq"].alias("first_seq"),
        F.max("loaded_count").alias("loaded_count"), F.max("total_count").alias("total_count"), F.sum("mentions").alias("mentions"),
        F.bool_or(is_home).alias("is_home"),
    ).withColumn("file_name", basename(F.col("full_path")))


def _under_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``file_key`` to rows with a ``path_key``; bare names find their file (of :func:`context_files`) by its name."""
    base = lambda c: F.lower(basename(F.col(c)))
    bare = is_bare_name(F.col("path_key"))
    homes = files.filter("is_home").select(*SESSION, base("full_path").alias("base"), F.col("file_key").alias("home"))
    out = rows.withColumn("base", F.when(bare, base("path_key")).otherwise(F.concat(F.lit("\x00"), "path_key")))
    return out.join(homes, [*SESSION, "base"], "left").withColumn("file_key", F.coalesce("home", "path_key"))


def mention_ranges(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """Line ranges of the mentions under the key of their file (``files`` from :func:`context_files`).

    Ranges are deduplicated per path first; bare names find their file by its name.
    """
    ranges = mentions.filter("start is not null").withColumn("path_key", F.lower("path")).groupBy(
        *SESSION, "path_key", "start"
    ).agg(F.max("end").alias("end"))
    return _under_files(ranges, files).select(*SESSION, "file_key", "start", "end")


def mention_places(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """The messages that mention a file, one row each: session, file_key, seq and ``place``, its number among them.

    Places count by file, so they are dealt in chunks of the line axis with the counts before them carried over.
    """
    seen = mentions.select(*SESSION, F.lower("path").alias("path_key"), "seq").distinct()
    rows = _under_files(seen, files).select(*SESSION, "file_key", "seq").distinct()
    one = {"place": F.lit(1).cast("bigint")}
    return running_sum(rows, [*SESSION, "file_key"], ["seq"], chunk_of(F.col("seq"), LINE_SPAN), one)


def clamp_ranges(ranges: DataFrame, total: Column) -> DataFrame:
    """Cut ranges to 1..total; without a known total only the lower bound applies."""
    top = F.when(total > 0, total).otherwise(F.lit((1 << 53) - 1))
    start = F.least(F.greatest(F.lit(1), F.col("start")), top)
    return ranges.withColumns({"start": start, "end": F.least(F.greatest(start, F.col("end")), top)})


def merge_ranges(ranges: DataFrame, keys: list[str], span: int = LINE_CHUNK) -> DataFrame:
    """Union of closed ranges per key: overlapping and adjacent ones become one.

    Ranges are first reduced to one row per (key, start line) on the map side, so a file that is read
    very often holds no more rows than it has lines; the running end is then scanned in chunks.
    """
    starts = ranges.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = chunk_scan(
        starts, keys, ["start"], chunk_of(F.col("start"), span),
        local=[{"_l": lambda w: F.max("end").over(before(w))}],
        summary={"_t": F.max("end")},
        carry=[{"_c": lambda w: F.max("_t").over(before(w)), "_all": lambda w: F.max("_t").over(whole(w))}],
    ).withColumn("_seen", F.greatest("_l", "_c"))
    heads = scanned.filter(F.col("_seen").isNull() | (F.col("start") > F.col("_seen") + 1))
    w = Window.partitionBy(*keys).orderBy("start")
    # A range ends where everything before the next head ends.
    end = F.coalesce(F.lead("_seen").over(w), F.col("_all"))
    return heads.select(*keys, "start", end.alias("end"))


def file_coverage(merged: DataFrame, keys: list[str], totals: DataFrame | None = None) -> DataFrame:
    """Loaded lines per file and, with ``totals`` (keys, total_count), percent and partial flag."""
    out = merged.groupBy(*keys).agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("loaded_lines"), F.count("*").alias("range_count")
    )
    if totals is None:
        return out
    out = out.join(totals, keys, "left")
    known = F.col("total_count") > 0
    share = F.floor(F.col("loaded_lines") * 100 / F.col("total_count") + 0.5)
    percent = F.when(known, F.least(F.lit(100), share)).otherwise(F.lit(100)).cast("bigint")
    return out.withColumns({"percent": percent, "is_partial": percent < 100})


def context_coverage(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """Coverage of every context file: ranges cut to the file, else its loaded count as reported."""
    keys = [*SESSION, "file_key"]
    totals = files.select(*keys, "total_count")
    ranges = mention_ranges(mentions, files).join(totals, keys, "left")
    merged = merge_ranges(clamp_ranges(ranges, F.col("total_count")).select(*keys, "start", "end"), keys)
    covered = file_coverage(merged, keys)
    out = files.select(*keys, "total_count", "loaded_count").join(covered, keys, "left")
    out = out.filter("loaded_lines IS NOT NULL OR loaded_count IS NOT NULL").withColumns({
        "loaded_lines": F.coalesce("loaded_lines", "loaded_count").cast("bigint"), "range_count": F.coalesce("range_count", F.lit(0).cast("bigint")),
    })
    share = F.floor(F.col("loaded_lines") * 100 / F.col("total_count") + 0.5)
    percent = F.when(F.col("total_count") > 0, F.least(F.lit(100), share)).otherwise(F.lit(100)).cast("bigint")
    return out.select(*keys, "loaded_lines", "range_count", "total_count", percent.alias("percent"), (percent < 100).alias("is_partial"))


def range_labels(merged: DataFrame) -> DataFrame:
    """Ranges with their display label ``L1-10``."""
    label = F.concat(F.lit("L"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return merged.withColumn("label", label)


def line_token_estimate(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of the loaded lines at four per line."""
    return coverage.groupBy(*keys).agg(
        F.sum("loaded_lines").alias("loaded_lines"), (F.sum("loaded_lines") * TOKENS_PER_LINE).alias("token_estimate")
    )
