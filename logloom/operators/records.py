"""Projections of parsed log records: facts, snapshots, tool uses, texts, compactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import variants as V
from logloom.functions.text import non_blank, non_empty

DIMS = ["project_id", "session_id", "file_path", "top_level", "seq"]


def content() -> V.Doc:
    """Content of a record's message; the text side is read only by operators that need key order."""
    return V.Doc(V.get(F.col("message"), "content"), F.get_json_object("line", "$.message.content"))


def is_user() -> Column:
    return F.coalesce((F.col("type") == "user") & (V.string_at(F.col("message"), "role") == "user"), F.lit(False))


def _tokens(message: Column) -> dict[str, Column]:
    return {
        "input_tokens": V.number_at(message, "usage.input_tokens"),
        "output_tokens": V.number_at(message, "usage.output_tokens"),
        "cache_write_tokens": V.number_at(message, "usage.cache_creation_input_tokens"),
        "cache_read_tokens": V.number_at(message, "usage.cache_read_input_tokens"),
    }


def usage_columns() -> list[Column]:
    """has_usage, the four counters, the cache split and the service tier of a message."""
    message = F.col("message")
    has = V.get(message, "usage", "struct<>").isNotNull()
    return [
        has.alias("has_usage"), *[F.when(has, c).alias(n) for n, c in _tokens(message).items()],
        V.number_at(message, "usage.cache_creation.ephemeral_5m_input_tokens").alias("cache_5m_tokens"),
        V.number_at(message, "usage.cache_creation.ephemeral_1h_input_tokens").alias("cache_1h_tokens"),
        V.string_at(message, "usage.service_tier").alias("service_tier"),
    ]


def _fact_columns() -> list[Column]:
    saved = V.number_at(F.col("microcompact_metadata"), "tokensSaved")
    return [
        F.col("type"), V.string_at(F.col("message"), "role").alias("role"), F.col("timestamp"), F.col("cwd"), F.col("git_branch"), F.col("version"),
        F.col("compact_metadata").isNotNull().alias("is_compaction"),
        F.col("microcompact_metadata").isNotNull().alias("is_microcompaction"),
        F.coalesce(saved, F.lit(0).cast("bigint")).alias("tokens_saved"),
    ]


def record_facts(records: DataFrame) -> DataFrame:
    """What session summaries need of each record."""
    return records.select(*DIMS, *_fact_columns())


def compaction_events(records: DataFrame) -> DataFrame:
    """Full and micro compactions of top-level files."""
    full, micro = F.col("compact_metadata"), F.col("microcompact_metadata")
    return records.filter(F.col("top_level") & (full.isNotNull() | micro.isNotNull())).select(
        *DIMS, "timestamp", full.isNotNull().alias("is_compaction"), micro.isNotNull().alias("is_microcompaction"),
        F.coalesce(V.string_at(full, "trigger"), V.string_at(micro, "trigger")).alias("trigger"),
        F.coalesce(V.number_at(full, "preTokens"), V.number_at(micro, "preTokens")).alias("pre_tokens"),
        F.coalesce(V.number_at(micro, "tokensSaved"), F.lit(0).cast("bigint")).alias("tokens_saved"),
    )


def turn_key() -> Column:
    """Message id, else record id, else timestamp, else one shared key."""
    return F.coalesce(
        non_empty(V.string_at(F.col("message"), "id")), non_empty(F.col("uuid")), non_empty(F.col("timestamp")),
        F.lit("unknown-assistant-turn"),
    )


def _snapshot_columns() -> list[Column]:
    body = content().value
    blocks = V.items(body)
    thinking = lambda b: V.is_object(b) & F.coalesce(V.string_at(b, "type") == "thinking", F.lit(False))
    shown = lambda b: V.is_object(b) & F.coalesce(
        ((V.string_at(b, "type") == "text") & non_blank(V.string_at(b, "text"))) | (V.string_at(b, "type") == "tool_use"),
        F.lit(False),
    )
    only = F.coalesce((F.size(blocks) > 0) & F.forall(blocks, thinking), F.lit(False))
    visible = F.when(V.is_string(body), non_blank(V.as_string(body))).otherwise(F.coalesce(F.exists(blocks, shown), F.lit(False)))
    return [
        turn_key().alias("turn_key"), V.string_at(F.col("message"), "model").alias("model"),
        V.string_at(F.col("message"), "id").alias("message_id"), *usage_columns(),
        only.alias("thinking_only"), visible.alias("visible"), V.string_at(F.col("message"), "stop_reason").alias("stop_reason"),
    ]


def snapshots(records: DataFrame) -> DataFrame:
    """One row per assistant record, as :func:`turns.collapse_turns` expects it."""
    return records.filter(F.col("type") == "assistant").select(*DIMS, "timestamp", *_snapshot_columns())


def _tool_column() -> Column:
    """(pos, tool_id, tool_name) of the tool uses of an assistant record."""

    def one(b: Column, i: Column) -> Column:
        name = F.coalesce(non_empty(V.string_at(b, "name")), F.lit("unknown"))
        ident = F.coalesce(non_empty(V.string_at(b, "id")), F.concat_ws("-", name, i.cast("string")))
        used = F.when(V.string_at(b, "type") == "tool_use", F.struct(i.alias("pos"), ident.alias("tool_id"), name.alias("tool_name")))
        return used

    return F.filter(F.transform(V.items(content().value), one), lambda t: t.isNotNull())


def log_facts(records: DataFrame) -> DataFrame:
    """Everything the session, turn and rollup operators need, in one pass and without the JSON.

    Materialise this table once; :func:`facts_of`, :func:`snapshots_of` and :func:`tool_uses_of` are
    projections of it.
    """
    said = F.col("type") == "assistant"
    tools = F.when(said & F.col("top_level"), _tool_column())
    return records.select(*DIMS, *_fact_columns(), *_snapshot_columns(), tools.alias("tools"))


def facts_of(slim: DataFrame) -> DataFrame:
    names = ["type", "role", "timestamp", "cwd", "git_branch", "version", "is_compaction", "is_microcompaction", "tokens_saved"]
    return slim.select(*DIMS, *names)


def snapshots_of(slim: DataFrame) -> DataFrame:
    return slim.filter("type = 'assistant'").drop("type", "role", "cwd", "git_branch", "version", "is_compaction", "is_microcompaction", "tokens_saved", "tools")


def tool_uses_of(slim: DataFrame) -> DataFrame:
    """Tool uses of top-level files by turn."""
    rows = slim.filter("tools is not null").select(*DIMS, "turn_key", F.explode("tools").alias("t"))
    return rows.select(*DIMS, "turn_key", "t.pos", "t.tool_id", "t.tool_name")


def explode_blocks(records: DataFrame) -> DataFrame:
    """One row per content block; a string content is one text block. Non-objects keep a NULL type."""
    body = content()
    text_block = F.array(
        F.struct(F.lit(None).cast("string").alias("text"), F.to_variant_object(F.struct(F.lit("text").alias("type"), V.as_string(body.value).alias("text"))).alias("value"))
    )
    rows = F.when(V.is_string(body.value), text_block).otherwise(V.elements(body))
    return (
        records.select(*DIMS, "type", turn_key().alias("turn_key"), rows.alias("rows"))
        .select(*DIMS, "type", "turn_key", F.posexplode("rows").alias("pos", "block"))
        .select(
            *DIMS, "type", "turn_key", "pos", V.string_at(F.col("block.value"), "type").alias("block_type"),
            F.col("block.value").alias("block"), F.col("block.text").alias("block_json"),
        )
    )


def extract_tool_uses(blocks: DataFrame) -> DataFrame:
    """Tool uses of assistant records. Missing names are ``unknown``, missing ids ``name-position``."""
    b = F.col("block")
    name = F.coalesce(non_empty(V.string_at(b, "name")), F.lit("unknown"))
    ident = F.coalesce(non_empty(V.string_at(b, "id")), F.concat_ws("-", name, F.col("pos").cast("string")))
    return blocks.filter((F.col("type") == "assistant") & (F.col("block_type") == "tool_use")).select(
        *DIMS, "turn_key", "pos", name.alias("tool_name"), ident.alias("tool_id"), V.get(b, "input").alias("input"),
        F.get_json_object("block_json", "$.input").alias("input_json"),
    )


def search_texts(records: DataFrame) -> DataFrame:
    """Searchable texts of top-level files: user texts and the text blocks of assistants."""
    body = content().value
    user = is_user()
    texts = F.filter(
        F.transform(V.items(body), lambda b: F.when(V.string_at(b, "type") == "text", V.string_at(b, "text"))),
        lambda s: s.isNotNull(),
    )
    plain = F.when(user & V.is_string(body), F.array(V.as_string(body)))
    rows = F.coalesce(plain, F.when(user | (F.col("type") == "assistant"), texts))
    return records.filter("top_level").select("project_id", "session_id", "seq", F.explode(rows).alias("text"))
