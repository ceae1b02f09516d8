"""Canonical log tables derived from the star-schema and event tables of a data folder.

They let every log operator run on plain Parquet tables; real logs come from ``sources.logs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
BASE_DATE = "2024-01-15"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def model_of_event() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "view", "claude-opus-4-7")
        .when(kind == "click", "claude-sonnet-4-6-20260504")
        .when(kind == "purchase", "claude-haiku-4-5-20251001")
        .when(kind == "signup", "claude-opus-4")
        .otherwise("unlisted-model")
    )


def events_base(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Events with session naming: one session per user and day, every tenth event a sub-agent's.

    ``spread`` deals the events to all tasks first: a few row groups of small rows are few tasks of much work.
    """
    events = load(spark, folder, "events")
    if spread:
        events = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *events.columns)
    user = F.col("user_id").cast("string")
    day = F.date_format("ts", "yyyy-MM-dd")
    top = (F.col("event_id") % 10) != 0
    session = F.concat_ws("-", user, day)
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", _k().alias("k"),
        user.alias("project_id"), session.alias("session_id"), top.alias("top_level"),
        F.when(top, F.concat(session, F.lit(".jsonl")))
        .otherwise(F.concat(session, F.lit("/subagents/a.jsonl"))).alias("file_path"),
        iso(F.col("ts")).alias("timestamp"),
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """One assistant turn per event."""
    tokens = {
        "input_tokens": F.floor(F.col("value") * 10).cast("bigint"),
        "output_tokens": F.floor("value").cast("bigint"),
        "cache_write_tokens": F.col("k") * 10,
        "cache_read_tokens": F.col("k") * 1000,
    }
    uses_tools = F.col("event_type").isin("click", "purchase") & F.col("top_level")
    return events_base(spark, folder).select(
        "project_id", "session_id", "file_path",
        F.col("event_id").cast("string").alias("turn_key"), F.col("event_id").alias("first_seq"),
        "top_level", "timestamp", model_of_event().alias("model"), F.lit(True).alias("has_usage"),
        *[c.alias(n) for n, c in tokens.items()],
        F.when(uses_tools, F.col("k") % 4).otherwise(0).cast("bigint").alias("tool_count"),
    )


TOOL_NAMES = ("Bash", "Edit", "Read", "Grep", "Write")


def turn_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Tool calls of the turns: one per click or purchase of a top-level file."""
    name = F.get(F.array(*[F.lit(n) for n in TOOL_NAMES]), (F.col("k") % len(TOOL_NAMES)).cast("int"))
    return (
        events_base(spark, folder)
        .filter(F.col("event_type").isin("click", "purchase") & F.col("top_level"))
        .select(
            "project_id", "session_id", "file_path", F.col("event_id").cast("string").alias("turn_key"),
            F.concat(F.lit("t"), (F.col("k") % 4).cast("string")).alias("tool_id"), name.alias("tool_name"),
        )
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Record-level session facts: views and sign-ups are user records, errors are compactions."""
    k, kind = F.col("k"), F.col("event_type")
    user = kind.isin("view", "signup")
    full = (kind == "error") & (k % 2 == 0)
    micro = (kind == "error") & (k % 2 == 1)
    return events_base(spark, folder).select(
        "project_id", "session_id", "file_path", "top_level", F.col("event_id").alias("seq"),
        F.when(user, "user").when(kind == "error", "system").otherwise("assistant").alias("type"),
        F.when(user, "user").when(kind == "error", F.lit(None)).otherwise("assistant").alias("role"),
        F.when(k % 7 != 0, F.col("timestamp")).alias("timestamp"),
        F.when(k % 3 != 0, F.concat(F.lit("/home/"), F.col("project_id"))).alias("cwd"),
        F.when(k % 5 != 0, F.concat(F.lit("branch-"), (k % 5).cast("string"))).alias("git_branch"),
        F.when(k % 4 != 0, F.concat(F.lit("1.0."), (k % 4).cast("string"))).alias("version"),
        full.alias("is_compaction"), micro.alias("is_microcompaction"),
        F.when(micro, k * 100).otherwise(0).cast("bigint").alias("tokens_saved"),
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant snapshots: the turn is (user, day, hour), views are thinking-only, errors lack usage."""
    kind, k = F.col("event_type"), F.col("k")
    has_usage = kind != "error"
    key = F.concat_ws("-", "project_id", F.date_format("ts", "yyyy-MM-dd-HH"))

    def used(col: Column) -> Column:
        return F.when(has_usage, col.cast("bigint"))

    return events_base(spark, folder).select(
        "project_id", "session_id", "file_path", key.alias("turn_key"), F.col("event_id").alias("seq"),
        "top_level",
        F.when(k % 6 != 0, F.col("timestamp")).alias("timestamp"),
        F.when(k % 4 != 0, model_of_event()).alias("model"), has_usage.alias("has_usage"),
        used(F.floor(F.col("value") * 10)).alias("input_tokens"), used(F.floor("value")).alias("output_tokens"),
        used(k * 10).alias("cache_write_tokens"), used(k * 1000).alias("cache_read_tokens"),
        F.when(has_usage, F.when(k % 2 == 0, "standard").otherwise("batch")).alias("service_tier"),
        used(k * 7).alias("cache_5m_tokens"), used(k * 3).alias("cache_1h_tokens"),
        (kind == "view").alias("thinking_only"), kind.isin("click", "purchase").alias("visible"),
        F.when(kind == "purchase", "end_turn").alias("stop_reason"),
    )


def snapshot_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Tool uses seen in the snapshots of top-level files."""
    kind, k = F.col("event_type"), F.col("k")
    return (
        events_base(spark, folder)
        .filter(kind.isin("click", "purchase") & F.col("top_level"))
        .select(
            "project_id", "session_id", "file_path",
            F.concat_ws("-", "project_id", F.date_format("ts", "yyyy-MM-dd-HH")).alias("turn_key"),
            F.col("event_id").alias("seq"), F.lit(0).alias("pos"),
            F.concat(F.lit("t"), (k % 4).cast("string")).alias("tool_id"),
            F.get(F.array(*[F.lit(n) for n in TOOL_NAMES]), (k % len(TOOL_NAMES)).cast("int")).alias("tool_name"),
        )
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation messages in turn order."""
    return load(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role",
        F.col("text").alias("content"),
    )


def flow(spark: SparkSession, folder: str) -> DataFrame:
    """Per user in time order: clicks use a tool, purchases return one, the rest are messages."""
    kind, k = F.col("event_type"), F.col("k")
    role = (
        F.when(kind == "click", "tool-use").when(kind == "purchase", "tool-result")
        .when(kind == "view", "assistant").when(kind == "signup", "user").otherwise("system")
    )
    return events_base(spark, folder).select(
        F.col("project_id").alias("session_id"), F.col("event_id").alias("seq"), role.alias("role"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("content"), "timestamp",
        F.when(kind.isin("click", "purchase"), F.concat(F.lit("t"), (k % 3).cast("string"))).alias("tool_id"),
        F.when(kind == "click", F.get(F.array(*[F.lit(n) for n in TOOL_NAMES]), (k % 5).cast("int"))).alias("tool_name"),
    ).select(
        "session_id", "seq", "role", "content", "timestamp", F.when(F.col("role") == "tool-result", F.col("tool_id")).alias("result_id"),
        F.when(
            F.col("role") == "tool-use", F.array(F.struct(F.col("tool_id").alias("id"), F.col("tool_name").alias("name")))
        ).alias("tools"),
    )


def line_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Line ranges: the file is a part, start is the quantity, length the line number."""
    start = F.col("l_quantity").cast("int")
    return load(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("file_key"), start.cast("bigint").alias("start"),
        (start + F.col("l_linenumber") - 1).cast("bigint").alias("end"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """JSON log lines made from the events: one file per user, lines in event order.

    Clicks are tool calls, purchases tool results, views thinking and text with usage, sign-ups user
    texts or commands, errors attachments or compactions. Some lines are broken or wrongly typed.
    """
    # Columns of their own: in one expression with the lines, the generated method is too large for the JVM to compile.
    file = "concat('src/f', k % 10, '.ts')"
    result = "concat('line ', k % 12, '\\nkeep ', k % 5)"
    call_input = f"""if(event_type = 'click', named_struct(
        'command', if(k % 4 = 2, concat('run ', k), null), 'timeout', if(k % 4 = 2, k * 1000, null),
        'query', if(k % 4 = 3, concat('q', k), null), 'file_path', if(k % 4 < 2, {file}, null),
        'startLine', if(k % 4 = 0 or (k % 4 = 1 and k % 8 = 1), k + 1, null), 'endLine', if(k % 4 = 0, k + 10, null),
        'old_string', if(k % 4 = 1, {result}, null),
        'new_string', if(k % 4 = 1, concat('line ', k % 12 + 4, '\\nkeep ', k % 5, '\\nadded'), null)), null)"""
    name = "case k % 4 when 0 then 'Read' when 1 then 'Edit' when 2 then 'Bash' else 'Grep' end"
    usage = """named_struct('input_tokens', cast(floor(value * 10) as bigint), 'output_tokens', cast(floor(value) as bigint),
        'cache_creation_input_tokens', k * 10, 'cache_read_input_tokens', k * 1000)"""
    message = lambda role, content, more="": f"'message', named_struct('role', '{role}', 'content', {content}{more})"
    own = "'id', concat('m', event_id), 'model', model, 'usage', _usage"
    bodies = {
        "click": "'type', 'assistant', " + message("assistant", f"array(named_struct('type', 'tool_use', 'id', concat('t', k % 3), 'name', {name}, 'input', _call))", ", 'stop_reason', 'tool_use', " + own),
        "purchase": "'type', 'user', " + message("user", "array(named_struct('type', 'tool_result', 'tool_use_id', concat('t', k % 3), 'content', concat('line ', k % 12, '\\nkeep ', k % 5)))")
        + f", 'toolUseResult', named_struct('type', 'text', 'filePath', {file}, 'numLines', k, 'totalLines', k * 2, 'exitCode', k % 3)",
        "view": "'type', 'assistant', " + message("assistant", "array(named_struct('type', 'thinking', 'thinking', if(k % 2 = 0, concat('Thought ', k), ''), 'signature', 'sig', 'text', null), named_struct('type', 'text', 'thinking', null, 'signature', null, 'text', concat('Seen ', event_id)))", ", 'stop_reason', 'end_turn', " + own),
        "signup": "'type', 'user', 'cwd', concat('/home/', user_id), " + message("user", "if(k % 5 = 0, concat('<command-name>/go</command-name><command-args>', k, '</command-args>'), concat('Question ', k))"),
    }
    attachment = f"'type', 'attachment', 'attachment', named_struct('type', 'file', 'displayPath', {file}, 'content', named_struct('file', named_struct('filePath', concat('/home/', user_id, '/', {file}), 'numLines', k, 'totalLines', k + 5, 'content', concat('text ', k))))"
    compaction = "'type', 'system', 'subtype', 'compact_boundary', 'compactMetadata', named_struct('trigger', 'auto', 'preTokens', k)"
    stamp = "'uuid', concat('u', event_id), 'timestamp', timestamp, "
    json = lambda body: f"to_json(named_struct({stamp}{body}))"
    cases = " ".join(f"when event_type = '{kind}' then {json(body)}" for kind, body in bodies.items())
    line = f"case {cases} when k % 2 = 0 then {json(attachment)} else {json(compaction)} end"
    base = events_base(spark, folder, spread=True).withColumns({"model": model_of_event(), "_call": F.expr(call_input), "_usage": F.expr(usage)})
    base = base.select("event_id", "user_id", F.explode(F.array(F.expr(line))).alias("line"))
    broken = F.when(F.col("event_id") % 97 == 5, F.substring("line", 1, 40)).when(
        F.col("event_id") % 97 == 6, F.regexp_replace("line", '"timestamp":"[^"]*"', '"timestamp":5')
    ).when(F.col("event_id") % 97 == 7, F.lit("  ")).otherwise(F.col("line"))
    project = F.concat(F.lit("-home-p"), (F.col("user_id") % 5).cast("string"))
    path = F.concat(F.lit("/logs/projects/"), project, F.lit("/u"), F.col("user_id").cast("string"), F.lit(".jsonl"))
    return base.select(broken.alias("value"), path.alias("file_path"), F.col("event_id").alias("seq"))
