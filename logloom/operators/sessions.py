"""Session and project summaries, listings, search and tool counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logloom.functions.models import model_display
from logloom.functions.text import non_empty
from logloom.operators.pricing import MICRO, TOKENS, price_usage, sum_micro

KEY = ["project_id", "session_id"]


def _first(value: Column, when: Column | None = None) -> Column:
    """First non-empty value in line order."""
    present = non_empty(value) if when is None else F.when(when, non_empty(value))
    return F.min_by(present, F.when(present.isNotNull(), F.col("seq")))


def _instant(text: Column) -> Column:
    return F.unix_millis(text.try_cast("timestamp"))


def _compaction_counts() -> list[Column]:
    """Aggregates over the records of a session's own log."""
    full, micro = F.col("top_level") & F.col("is_compaction"), F.col("top_level") & F.col("is_microcompaction")
    return [
        F.count_if(full).alias("compactions"), F.count_if(micro).alias("microcompactions"),
        F.sum(F.when(micro, F.coalesce("tokens_saved", F.lit(0))).otherwise(0)).alias("tokens_saved"),
    ]


def compaction_stats(facts: DataFrame) -> DataFrame:
    """Full and micro compactions and tokens saved per session."""
    return facts.filter("top_level").groupBy(*KEY).agg(*_compaction_counts())


def compaction_times(facts: DataFrame) -> DataFrame:
    """One row per compaction with a timestamp, in line order by ``seq``."""
    return facts.filter(
        F.col("top_level") & (F.col("is_compaction") | F.col("is_microcompaction"))
        & non_empty(F.col("timestamp")).isNotNull()
    ).select(*KEY, "seq", "timestamp")


def session_span(facts: DataFrame, *more: Column) -> DataFrame:
    """First-seen metadata, start, end and duration per session that has a top-level file.

    The end is the last top-level line with a timestamp, raised by later sub-agent lines. ``more``
    aggregates are computed in the same pass.
    """
    top = F.col("top_level")
    ts = non_empty(F.col("timestamp"))
    top_ts = F.when(top, ts)
    last_line = F.max_by(top_ts, F.when(top_ts.isNotNull(), F.col("seq")))
    spans = facts.groupBy(*KEY).agg(
        F.count_if(top).alias("_lines"),
        F.count_if(top & (F.col("type") == "user") & (F.col("role") == "user")).alias("user_count"),
        _first(F.col("timestamp"), top).alias("started_at"),
        last_line.alias("_last"),
        F.max(F.when(~top, ts)).alias("_sub_last"),
        _first(F.col("git_branch"), top).alias("git_branch"),
        _first(F.col("cwd"), top).alias("cwd"),
        _first(F.col("version"), top).alias("version"),
        *more,
    )
    end = F.greatest("_last", "_sub_last")
    duration = F.coalesce(_instant(end) - _instant(F.col("started_at")), F.lit(0).cast("bigint"))
    return (
        spans.filter("_lines > 0")
        .withColumn("ended_at", end)
        .withColumn("duration_ms", duration)
        .drop("_lines", "_last", "_sub_last")
    )


def _turn_order() -> Column:
    """Order in which turns are first seen: top-level file first, then sub-agent files by path."""
    return F.struct((~F.col("top_level")).alias("sub"), "file_path", "first_seq")


def session_models(turns: DataFrame) -> DataFrame:
    """Distinct models per session with the place of their first turn."""
    return (
        turns.filter("model <> ''")
        .groupBy(*KEY, "model")
        .agg(F.min(_turn_order()).alias("first_turn"))
    )


def session_usage(turns: DataFrame) -> DataFrame:
    """Turn count and token sums per session and model."""
    return turns.groupBy(*KEY, "model").agg(
        F.count_if("top_level").alias("assistant_count"),
        F.min(_turn_order()).alias("first_turn"),
        *[F.sum(F.coalesce(F.col(t), F.lit(0))).alias(t) for t in TOKENS],
    )


def tool_usage(turn_tools: DataFrame) -> DataFrame:
    """Calls per session and tool."""
    return turn_tools.groupBy(*KEY, "tool_name").agg(F.count("*").alias("calls"))


def session_summary(facts: DataFrame, turns: DataFrame, turn_tools: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per session: counts, tokens, exact costs, first model, metadata and compactions.

    Each input is reduced to one row per session with map-side combining before the joins, so a
    session that holds a large share of all rows never meets in one task.
    """
    usage = price_usage(session_usage(turns), prices)
    totals = usage.groupBy(*KEY).agg(
        F.sum("assistant_count").alias("assistant_count"),
        *[F.sum(t).alias(t) for t in TOKENS],
        *sum_micro(),
        F.min_by(non_empty(F.col("model")), F.when(F.col("model") != "", F.col("first_turn"))).alias("model"),
        F.count(non_empty(F.col("model"))).alias("model_count"),
    )
    calls = turn_tools.groupBy(*KEY).agg(F.count("*").alias("tool_count"))
    joined = (
        session_span(facts, *_compaction_counts())
        .join(totals, KEY, "left")
        .join(calls, KEY, "left")
    )
    zero = F.lit(0).cast("bigint")
    counts = ["assistant_count", "tool_count", "model_count", "compactions", "microcompactions", "tokens_saved", *TOKENS]
    filled = joined.withColumns({c: F.coalesce(F.col(c), zero) for c in counts})
    filled = filled.withColumns({m: F.coalesce(F.col(m), F.lit(0).cast("decimal(38,10)")) for m in MICRO})
    return filled.withColumn("model", F.coalesce("model", F.lit("unknown"))).withColumn(
        "message_count", F.col("user_count") + F.col("assistant_count")
    )


def project_summary(sessions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Sessions, messages, tokens and costs per project, most recently active first.

    ``files`` (project_id, modified_at) gives the last activity; without it the newest session end.
    """
    out = sessions.groupBy("project_id").agg(
        F.count("*").alias("session_count"),
        F.sum("message_count").alias("message_count"),
        F.sum(sum((F.col(t) for t in TOKENS), F.lit(0))).alias("total_tokens"),
        *[F.sum(t).alias(t) for t in TOKENS],
        *sum_micro(),
        F.max("ended_at").alias("last_record_at"),
    )
    if files is None:
        out = out.withColumn("last_active", F.col("last_record_at"))
    else:
        active = files.groupBy("project_id").agg(F.max("modified_at").alias("last_active"))
        out = out.join(active, "project_id", "left")
    return out.orderBy(F.desc_nulls_last("last_active"), "project_id")


def project_models(turns: DataFrame) -> DataFrame:
    """Distinct model display names per project, one row each."""
    return (
        turns.filter("model <> ''").select("project_id", model_display(F.col("model")).alias("display_name")).distinct()
    )


def list_sessions(sessions: DataFrame, limit: int | None = 50, offset: int = 0, project: str | None = None) -> DataFrame:
    """Newest sessions first. A project's own list is complete: neither limit nor offset apply."""
    order = [F.desc_nulls_last("started_at"), F.col("session_id"), F.col("project_id")]
    if project is not None:
        return sessions.filter(F.col("project_id") == project).orderBy(*order)
    page = sessions.orderBy(*order)
    if offset:
        page = page.offset(offset)
    return page if limit is None else page.limit(limit)


def search_sessions(texts: DataFrame, sessions: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """Sessions with a user text or assistant text block containing ``query``, newest first.

    ``texts`` holds one searchable text per row (session key, ``text``). The filter runs before the
    semi join; its matches are reduced to distinct sessions on the map side.
    """
    if not query.strip():
        return list_sessions(sessions, limit)
    keys = [c for c in KEY if c in texts.columns]
    hits = texts.filter(F.contains(F.lower("text"), F.lit(query.lower()))).select(*keys).distinct()
    return list_sessions(sessions.join(hits, keys, "left_semi"), limit)


def project_detail(sessions: DataFrame) -> DataFrame:
    """Totals per project: sessions, messages, tool calls, costs."""
    return sessions.groupBy("project_id").agg(
        F.count("*").alias("session_count"), F.sum("message_count").alias("message_count"),
        F.sum("tool_count").alias("tool_count"), *sum_micro(),
    )


def top_project_tools(tools: DataFrame, top: int = 8) -> DataFrame:
    """The most used tools of each project; ``tools`` is the output of :func:`tool_usage`."""
    calls = tools.groupBy("project_id", "tool_name").agg(F.sum("calls").alias("calls"))
    w = Window.partitionBy("project_id").orderBy(F.desc("calls"), "tool_name")
    return calls.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def top_session_tools(tools: DataFrame, top: int = 10) -> DataFrame:
    """The most used tools of each session with their share of the session's maximum."""
    w = Window.partitionBy(*KEY)
    ranked = tools.withColumn(
        "rank", F.row_number().over(w.orderBy(F.desc("calls"), "tool_name"))
    ).withColumn("share_of_max", F.col("calls") / F.max("calls").over(w))
    return ranked.filter(F.col("rank") <= top)


def project_names(facts: DataFrame) -> DataFrame:
    """Project path and name: the first ``cwd`` of the first top-level file, else the decoded id."""
    from logloom.functions.text import basename, project_name, project_path

    top = facts.filter(F.col("top_level"))
    cwd = non_empty(F.col("cwd"))
    per_file = top.groupBy("project_id", "file_path").agg(_first(F.col("cwd")).alias("cwd"))
    first = per_file.groupBy("project_id").agg(F.min_by("cwd", "file_path").alias("cwd"))
    return first.select(
        "project_id",
        F.coalesce(basename(cwd), project_name(F.col("project_id"))).alias("project_name"),
        F.coalesce(cwd, project_path(F.col("project_id"))).alias("project_path"),
    )
