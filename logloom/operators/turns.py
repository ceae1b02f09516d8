"""Assistant turns: collapsing repeated snapshots of one message and merging usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import non_empty
from logloom.operators.pricing import TOKENS, price_usage, sum_micro
from logloom.operators.scans import LINE_SPAN, chunk_of

TURN = ["project_id", "session_id", "file_path", "turn_key"]


def _latest(value: Column, present: Column, order: str = "seq") -> Column:
    return F.max_by(value, F.when(present, F.col(order)))


def collapse_turns(snapshots: DataFrame, span: int = LINE_SPAN) -> DataFrame:
    """One row per turn: last non-empty model and timestamp, last usage, recovered cache writes.

    A turn may begin with thinking-only snapshots whose cache write is not in the final usage. It is
    added back when the first other snapshot with usage shows content and ends the turn.

    Snapshots are first reduced inside chunks of the line axis, so a key shared by very many lines
    (records without any id) is spread over tasks; the chunk rows are then reduced per turn.
    """
    used = F.col("has_usage")
    thinking = used & F.col("thinking_only")
    ts, model = non_empty(F.col("timestamp")), non_empty(F.col("model"))
    usage = F.struct(*TOKENS)

    rows = snapshots.withColumn("_chunk", chunk_of(F.col("seq"), span))
    first_open = F.min(F.when(used & ~F.col("thinking_only"), F.col("seq")))
    rows = rows.withColumn("_f", first_open.over(Window.partitionBy(*TURN, "_chunk")))
    ends = F.col("visible") & F.coalesce(F.col("stop_reason") == "end_turn", F.lit(False))
    before = thinking & (F.col("_f").isNull() | (F.col("seq") < F.col("_f")))
    chunks = rows.groupBy(*TURN, "_chunk").agg(
        F.min("seq").alias("first_seq"),
        F.bool_or("top_level").alias("top_level"),
        _latest(ts, ts.isNotNull()).alias("timestamp"),
        _latest(model, model.isNotNull()).alias("model"),
        F.bool_or(used).alias("has_usage"),
        _latest(usage, used).alias("usage"),
        F.count("*").alias("snapshots"),
        F.min("_f").alias("_f"),
        F.bool_or((F.col("seq") == F.col("_f")) & ends).alias("_ends"),
        _latest(F.coalesce("cache_write_tokens", F.lit(0)), before).alias("_held"),
    )
    opened = F.min(F.when(F.col("_f").isNotNull(), F.col("_chunk"))).over(Window.partitionBy(*TURN))
    chunks = chunks.withColumn("_open", opened)
    at_open = F.col("_chunk") == F.col("_open")
    held = F.col("_held").isNotNull() & (F.col("_chunk") <= F.col("_open"))
    turns = chunks.groupBy(*TURN).agg(
        F.min("first_seq").alias("first_seq"),
        F.bool_or("top_level").alias("top_level"),
        _latest(F.col("timestamp"), F.col("timestamp").isNotNull(), "_chunk").alias("timestamp"),
        _latest(F.col("model"), F.col("model").isNotNull(), "_chunk").alias("model"),
        F.bool_or("has_usage").alias("has_usage"),
        _latest(F.col("usage"), F.col("has_usage"), "_chunk").alias("usage"),
        F.sum("snapshots").alias("snapshots"),
        F.coalesce(F.bool_or(at_open & F.col("_ends")), F.lit(False)).alias("_ends"),
        _latest(F.col("_held"), held, "_chunk").alias("_held"),
    )
    zero = F.lit(0).cast("bigint")
    recovered = F.when(F.col("_ends"), F.coalesce("_held", zero)).otherwise(zero)
    tokens = {t: F.when(F.col("has_usage"), F.coalesce(F.col(f"usage.{t}"), zero)) for t in TOKENS}
    tokens["cache_write_tokens"] = tokens["cache_write_tokens"] + recovered
    return turns.select(
        *TURN, "first_seq", "top_level", F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        F.coalesce("model", F.lit("")).alias("model"), "has_usage",
        *[c.alias(t) for t, c in tokens.items()], recovered.alias("recovered_cache_write"), "snapshots",
    )


def turn_tools(tool_uses: DataFrame) -> DataFrame:
    """Distinct tool calls per turn by id; the last name seen for an id wins."""
    return tool_uses.groupBy(*TURN, "tool_id").agg(F.max_by("tool_name", F.struct("seq", "pos")).alias("tool_name"))


def with_tool_counts(turns: DataFrame, tools: DataFrame) -> DataFrame:
    counts = tools.groupBy(*TURN).agg(F.count("*").alias("tool_count"))
    return turns.join(counts, TURN, "left").withColumn("tool_count", F.coalesce("tool_count", F.lit(0).cast("bigint")))


def merge_usage(messages: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """Usage of a set of messages: one usage per message id (the last), summed per ``by``.

    Needs seq, message_id, model, has_usage, the token counters, cache_5m_tokens, cache_1h_tokens and
    service_tier. Groups without any usage are absent.
    """
    parts = [*TOKENS, "cache_5m_tokens", "cache_1h_tokens"]
    ident = F.coalesce(non_empty(F.col("message_id")), F.concat(F.lit("#"), F.col("seq").cast("string")))
    unique = (
        messages.filter("has_usage")
        .groupBy(*by, ident.alias("ident"))
        .agg(
            F.min("seq").alias("first_seq"),
            F.max_by(F.struct("model", "service_tier", *parts), "seq").alias("last"),
        )
        .select(*by, "first_seq", "last.*")
    )
    sums = [F.sum(F.coalesce(F.col(p), F.lit(0))).alias(p) for p in parts]
    tier = F.max(F.struct("first_seq", "service_tier")).alias("tier")
    per_model = unique.groupBy(*by, "model").agg(*sums, F.count("*").alias("messages"), tier)
    priced = price_usage(per_model, prices)
    return priced.groupBy(*by).agg(
        *[F.sum(p).alias(p) for p in parts], F.sum("messages").alias("messages"),
        F.max("tier")["service_tier"].alias("service_tier"), *sum_micro(),
    )
