"""Queries on stored state: refreshed twice, and fed batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.pricing import MICRO, costs_rounded
from logloom.operators.search import build_text_index, search_index
from logloom.plans import core_queries, log_queries, sqlparts as q
from logloom.session import cut_lineage, shared_folder
from logloom.sources import logs, tables as t
from logloom.sources.datasets import import_dataset, read_dataset, write_export
from logloom.sources.prices import default_prices, read_prices
from logloom.streaming import store as ST

KEEP = ["session_id", "user_count", "assistant_count", "message_count", "tool_count", "compactions", "cwd", "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens"]


def _lines_and_middle(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    lines = cut_lineage(logs.with_path_dims(t.log_lines(spark, d)))
    return lines, (lines.agg(F.max("seq")).first()[0] or 0) // 2


def _sessions(state: ST.Store) -> DataFrame:
    return state.table("sessions").select(*KEEP, *costs_rounded()).drop(*MICRO)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def refreshed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session totals of a store that was filled when half of the lines were written and refreshed when all were."""
    lines, middle = _lines_and_middle(spark, d)
    prices, folder = default_prices(spark), _folder(spark)
    state = None
    for part in (lines.filter(F.col("seq") <= middle), lines):
        files = part.groupBy("file_path", *ST.SESSION, "top_level").agg(
            F.concat_ws(":", F.count("*"), F.max("seq")).alias("signature"), F.lit(None).cast("timestamp").alias("modified_at"), F.sum(F.octet_length("value")).alias("bytes")
        )
        some = lambda changed, everything, part=part: part.join(changed.select("file_path"), "file_path", "left_semi").select(part.columns)
        state = ST.refresh(spark, folder, files, some, prices)
    return _sessions(state)


def appended_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session totals of a store that got the lines as two batches of chunks, the first of them twice."""
    lines, middle = _lines_and_middle(spark, d)
    prices, folder = default_prices(spark), _folder(spark)
    number = F.when(F.col("seq") <= middle, 0).otherwise(1)
    chunk = F.concat(F.lit("/chunks/"), number.cast("string"), F.regexp_replace("file_path", r"\A/logs", ""))
    room = lines.agg(F.max("seq")).first()[0] or 0
    chunks = lines.select("value", chunk.alias("chunk_path"), F.lit(room + 1).cast("bigint").alias("chunk_bytes"), F.col("seq").alias("offset"), number.alias("batch"))
    chunks = cut_lineage(chunks.repartition("chunk_path").sortWithinPartitions("chunk_path", "offset"))
    state = None
    for batch in (0, 0, 1):
        part = chunks.filter(F.col("batch") == batch).repartition("chunk_path").sortWithinPartitions("chunk_path", "offset")
        state = ST.append_chunks(spark, folder, part, batch, prices)
    return _sessions(state)


def imported_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and lines of a dataset that was exported, imported twice under checksums, and read back."""
    lines = logs.with_path_dims(t.log_lines(spark, d))
    relative = F.regexp_extract("file_path", r"projects/[^/]+/(.+)\z", 1)
    out, target = _folder(spark), _folder(spark)
    write_export(lines.select("project_id", "session_id", relative.alias("file"), "seq", "value"), out, "query")
    for _ in range(2):
        import_dataset(spark, out, target)
    read = logs.with_path_dims(read_dataset(spark, target))
    return read.groupBy("project_id", "session_id").agg(F.count("*").alias("line_count"), F.max("seq").alias("last_seq"))


def _document(rows: DataFrame, name: str, folder: str) -> None:
    """Write the one text in column ``doc`` as a file that whole-file readers take."""
    rows.select("doc").coalesce(1).write.text(f"{folder}/{name}")


def price_file(spark: SparkSession, d: str) -> DataFrame:
    """Prices read from a price file with one model per part."""
    folder = _folder(spark)
    price = lambda n: (F.col("p_size") * n / F.lit(10)).cast("decimal(12,8)")
    entry = F.struct(
        F.lit("anthropic").alias("provider"), price(10).alias("inputPerMillion"), price(50).alias("outputPerMillion"),
        price(12).alias("cacheWritePerMillion"), F.when(F.col("p_size") % 2 == 0, price(1)).alias("cacheReadPerMillion"),
    )
    name = F.concat(F.lit("model-"), F.col("p_partkey").cast("string"))
    entries = F.map_from_entries(F.collect_list(F.struct(name.alias("key"), entry.alias("value"))))
    _document(t.load(spark, d, "part").agg(F.to_json(F.struct(entries.alias("models"))).alias("doc")), "prices.json", folder)
    out = read_prices(spark, f"{folder}/prices.json")
    return out.select("model", "provider", *[F.col(c).cast("double").alias(c) for c in out.columns[2:]])


def rollup_base(spark: SparkSession, d: str) -> DataFrame:
    """A rollup base that Spark writes from the events and :func:`logs.read_rollup_base` reads: (part, name, amount) rows."""
    folder, ev = _folder(spark), t.events_base(spark, d).withColumn("model", t.model_of_event())
    day = F.substring("timestamp", 1, 10)
    listed = lambda df, name: df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))
    keyed = lambda df, key, value: df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("v"))
    days = ev.groupBy(day.alias("date")).agg(F.count("*").alias("messageCount"), F.count_distinct("project_id").alias("sessionCount"), F.sum("k").alias("toolCallCount"))
    by_model = ev.groupBy(day.alias("date"), "model").agg(F.count("*").alias("n")).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("model", "n"))).alias("tokensByModel"))
    usage = ev.groupBy("model").agg(F.struct(F.sum("k").alias("inputTokens"), F.count("*").alias("outputTokens")).alias("u"))
    hours = ev.groupBy(F.substring("timestamp", 12, 2).cast("int").cast("string").alias("hour")).agg(F.count("*").alias("n"))
    texts = {
        "dailyActivity": listed(days, "v"), "dailyModelTokens": listed(by_model, "v"), "modelUsage": keyed(usage, "model", "u"), "hourCounts": keyed(hours, "hour", "n"),
        "totalSessions": ev.agg(F.count_distinct("project_id").cast("string").alias("v")), "totalMessages": ev.agg(F.count("*").cast("string").alias("v")),
    }
    parts = [df.select(F.lit(f'"{name}":').alias("name"), "v") for name, df in texts.items()]  # one row each
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    doc = F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat("name", "v")), ","), F.lit("}"))
    _document(whole.agg(doc.alias("doc")), "stats-cache.json", folder)
    base = logs.read_rollup_base(spark, folder)
    row = lambda df, part, name, amount: df.select(F.lit(part).alias("part"), name.alias("name"), F.coalesce(amount, F.lit(0)).cast("bigint").alias("amount"))
    out = row(base["activity"], "messages", F.col("date"), F.col("message_count"))
    for more in (
        row(base["activity"], "sessions", F.col("date"), F.col("session_count")), row(base["activity"], "calls", F.col("date"), F.col("tool_call_count")),
        row(base["daily_models"], "tokens", F.concat_ws("|", "date", "model"), F.col("tokens")),
        row(base["models"], "input", F.col("model"), F.col("input_tokens")), row(base["models"], "output", F.col("model"), F.col("output_tokens")),
        row(base["hours"], "hours", F.col("hour").cast("string"), F.col("turn_count")),
        row(base["totals"], "totals", F.lit("sessions"), F.col("session_count")), row(base["totals"], "totals", F.lit("messages"), F.col("message_count")),
    ):
        out = out.unionByName(more)
    return out


def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """:func:`core_queries.text_search` over an index that skips parts."""
    m = t.messages(spark, d)
    begun = m.groupBy("session_id").agg(F.count("*").alias("message_count")).withColumns({"project_id": F.lit("p"), "started_at": F.lpad("session_id", 12, "0")})
    folder = _folder(spark)
    build_text_index(m.filter(F.col("role").isin("user", "assistant")).select("session_id", F.col("content").alias("text")), folder)
    return search_index(spark, folder, begun, "The By")


QUERIES = {f.__name__: f for f in (refreshed_sessions, appended_sessions, imported_files, price_file, rollup_base, indexed_search)}
ORACLE = {name: log_queries.ORACLE["log_session_summary"] for name in ("refreshed_sessions", "appended_sessions")} | {
    "indexed_search": core_queries.ORACLE["text_search"],
    "imported_files": "select '-home-p'||(user_id % 5) project_id, 'u'||user_id session_id, count(*) line_count, max(event_id) last_seq from events group by all",
    "price_file": """select 'model-'||p_partkey model, 'anthropic' provider, p_size::double input_price, p_size * 5.0::double output_price, p_size * 12 / 10.0::double cache_write_price,
      case when p_size % 2 = 0 then p_size / 10.0::double end cache_read_price from part""",
    "rollup_base": q.with_(["ev"], """select part, "name", amount::bigint amount from (
      select 'messages' part, d "name", count(*) amount from days group by all union all select 'sessions', d, count(distinct project_id) from days group by all
      union all select 'calls', d, sum(k) from days group by all union all select 'tokens', d||'|'||model, count(*) from days group by all
      union all select 'input', model, sum(k) from days group by all union all select 'output', model, count(*) from days group by all
      union all select 'hours', cast(substr(tstamp, 12, 2)::int as varchar), count(*) from days group by all
      union all select 'totals', 'sessions', count(distinct project_id) from days union all select 'totals', 'messages', count(*) from days)""",
        "days as (select *, substr(tstamp, 1, 10) d from ev)"),
}
