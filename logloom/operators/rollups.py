"""Day, model and hour rollups, and merging them into an earlier base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import non_empty
from logloom.operators.pricing import MICRO, TOKENS, allocate_costs, match_used, price_usage, sum_micro, with_costs
from logloom.session import cut_lineage

KEY = ["project_id", "session_id"]


def _date() -> Column:
    return F.substring("timestamp", 1, 10)


def _dated(df: DataFrame, after: str | None) -> DataFrame:
    """Rows with a timestamp, after the base date if one is given."""
    dated = df.filter(non_empty(F.col("timestamp")).isNotNull()).withColumn("date", _date())
    return dated.filter(F.col("date") > after) if after else dated


def user_records(facts: DataFrame) -> DataFrame:
    return facts.filter("top_level and type = 'user' and role = 'user'")


def session_days(facts: DataFrame, turns: DataFrame, after: str | None = None) -> DataFrame:
    """The one day a session counts on: its first qualifying user record, else first turn."""
    users = _dated(user_records(facts), after).select(
        *KEY, "date", F.struct(F.lit(0).alias("kind"), F.lit("").alias("file"), F.col("seq")).alias("at")
    )
    kind = F.when(F.col("top_level"), 1).otherwise(2)
    seen = _dated(turns, after).select(
        *KEY, "date", F.struct(kind.alias("kind"), F.col("file_path").alias("file"), F.col("first_seq").alias("seq")).alias("at")
    )
    return users.unionByName(seen).groupBy(*KEY).agg(F.min_by("date", "at").alias("date"))


def daily_activity(facts: DataFrame, turns: DataFrame, after: str | None = None) -> DataFrame:
    """Messages, sessions and tool calls per day. A session counts only on a day with messages."""
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    users = _dated(user_records(facts), after).select("date", one.alias("m"), zero.alias("s"), zero.alias("t"))
    said = _dated(turns, after).filter("top_level").select("date", one.alias("m"), zero.alias("s"), F.col("tool_count").alias("t"))
    began = session_days(facts, turns, after).select("date", zero.alias("m"), one.alias("s"), zero.alias("t"))
    return (
        users.unionByName(said).unionByName(began)
        .groupBy("date")
        .agg(
            F.sum("m").alias("message_count"), F.sum("s").alias("session_count"), F.sum("t").alias("tool_call_count")
        )
        .filter("message_count > 0")
    )


def _token_sums() -> list[Column]:
    return [F.sum(F.coalesce(F.col(t), F.lit(0))).alias(t) for t in TOKENS]


def _used(turns: DataFrame, after: str | None) -> DataFrame:
    return _dated(turns, after).filter("has_usage and model <> ''")


def daily_tokens(turns: DataFrame, after: str | None = None) -> DataFrame:
    """Tokens per day and model, without costs."""
    total = sum((F.coalesce(F.col(t), F.lit(0)) for t in TOKENS), F.lit(0))
    return _used(turns, after).groupBy("date", "model").agg(F.sum(total).alias("tokens"))


def daily_model(turns: DataFrame, prices: DataFrame, after: str | None = None, matched: DataFrame | None = None) -> DataFrame:
    """Tokens and costs per day and model."""
    sums = _used(turns, after).groupBy("date", "model").agg(*_token_sums())
    total = sum((F.col(t) for t in TOKENS), F.lit(0))
    return price_usage(sums, prices, matched).select("date", "model", total.alias("tokens"), *MICRO)


def model_usage(turns: DataFrame, prices: DataFrame, after: str | None = None, matched: DataFrame | None = None) -> DataFrame:
    """The four token counters and costs per model."""
    return price_usage(_used(turns, after).groupBy("model").agg(*_token_sums()), prices, matched)


def hour_counts(turns: DataFrame, after: str | None = None) -> DataFrame:
    """Turns with usage per hour of the day (UTC, whole numbers)."""
    used = _dated(turns, after).filter("has_usage")
    hour = F.substring("timestamp", 12, 2).try_cast("int")
    return used.groupBy(hour.alias("hour")).agg(F.count("*").alias("turn_count"))


def totals(facts: DataFrame, turns: DataFrame, prices: DataFrame, after: str | None = None) -> DataFrame:
    """One row: sessions, messages, tokens and costs.

    Records and turns are each read once and reduced to one row per session and model, from which
    all totals follow. Only turns with usage and a model name are priced.
    """
    zero = F.lit(0).cast("bigint")
    said = F.when(F.col("top_level"), 1).otherwise(0).cast("bigint")
    users = _dated(user_records(facts), after).select(
        *KEY, F.lit(None).cast("string").alias("model"), F.lit(1).cast("bigint").alias("messages"), *[zero.alias(t) for t in TOKENS]
    )
    used = _dated(turns, after).select(
        *KEY, F.when(F.col("has_usage"), non_empty(F.col("model"))).alias("model"), said.alias("messages"),
        *[F.when(F.col("has_usage"), F.coalesce(F.col(t), zero)).otherwise(zero).alias(t) for t in TOKENS],
    )
    sums = users.unionByName(used).groupBy(*KEY, "model").agg(F.sum("messages").alias("messages"), *[F.sum(t).alias(t) for t in TOKENS])
    sums = cut_lineage(sums)
    total = sum((F.col(t) for t in TOKENS), F.lit(0))
    counts = sums.groupBy(*KEY).agg(F.sum("messages").alias("messages"), F.sum(total).alias("tokens")).agg(
        F.count("*").alias("session_count"), F.sum("messages").alias("message_count"), F.sum("tokens").alias("total_tokens")
    )
    named = sums.filter("model IS NOT NULL")
    by_model = named.groupBy("model").agg(*[F.sum(t).alias(t) for t in TOKENS])
    costs = with_costs(by_model, match_used(named, prices)).agg(*sum_micro())
    return _one_row(counts.unionByName(costs, allowMissingColumns=True))


def _one_row(rows: DataFrame) -> DataFrame:
    """Totals from rows that each hold some of them."""
    zero = F.lit(0).cast("bigint")
    return rows.agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("session_count", "message_count", "total_tokens")],
        *[F.coalesce(F.sum(m).cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)")).alias(m) for m in MICRO],
    )


def all_rollups(facts: DataFrame, turns: DataFrame, prices: DataFrame, after: str | None = None) -> dict[str, DataFrame]:
    """activity, daily_models, models, hours and totals at once, equal to the functions of their own.

    User records and turns are each read twice: once for the day on which a session counts, and once for everything else,
    as grouping sets over one slim table. Its few rows (days, models, hours) are written, matched with the prices
    once, and all tables are cut from them.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    text, hour = F.lit(None).cast("string"), F.substring("timestamp", 12, 2).try_cast("int")
    used = F.col("has_usage")
    users = _dated(user_records(facts), after).select(
        "date", text.alias("model"), F.lit(None).cast("int").alias("hour"), zero.alias("used"), one.alias("messages"), zero.alias("tools"), *[zero.alias(t) for t in TOKENS]
    )
    top = F.when(F.col("top_level"), one).otherwise(zero)
    said = _dated(turns, after).select(
        "date", F.when(used, non_empty(F.col("model"))).alias("model"), hour.alias("hour"), F.when(used, one).otherwise(zero).alias("used"),
        top.alias("messages"), (top * F.coalesce("tool_count", zero)).alias("tools"),
        *[F.when(used, F.coalesce(F.col(t), zero)).otherwise(zero).alias(t) for t in TOKENS],
    )
    sums = [F.sum(c).alias(c) for c in ("used", "messages", "tools", *TOKENS)]
    sets = [[F.col("date")], [F.col("date"), F.col("model")], [F.col("model")], [F.col("hour")]]
    rolled = users.unionByName(said).groupingSets(sets, "date", "model", "hour").agg(F.grouping_id("date", "model", "hour").alias("by"), *sums)
    rolled = cut_lineage(rolled)
    # Bits of ``by``, from the left: date, model, hour left out.
    days, daily, models, hours = (rolled.filter(F.col("by") == by) for by in (0b011, 0b001, 0b101, 0b110))
    matched = match_used(models.filter("model IS NOT NULL"), prices)
    began = cut_lineage(session_days(facts, turns, after).groupBy("date").agg(F.count("*").alias("session_count")))
    usage = with_costs(models.filter("model IS NOT NULL").select("model", *TOKENS), matched)
    total = sum((F.col(t) for t in TOKENS), F.lit(0))
    counts = days.agg(F.sum("messages").alias("message_count"), F.sum(total).alias("total_tokens"))
    rows = counts.unionByName(began.agg(F.sum("session_count").alias("session_count")), allowMissingColumns=True)
    return {
        "activity": days.filter("messages > 0").join(F.broadcast(began), "date", "left").select(
            "date", F.col("messages").alias("message_count"), F.coalesce("session_count", zero).alias("session_count"), F.col("tools").alias("tool_call_count")
        ),
        "daily_models": with_costs(daily.filter("model IS NOT NULL"), matched).select("date", "model", total.alias("tokens"), *MICRO),
        "models": usage,
        "hours": hours.filter("used > 0").select("hour", F.col("used").alias("turn_count")),
        "totals": _one_row(rows.unionByName(usage.agg(*sum_micro()), allowMissingColumns=True)),
    }


def merge_rollup(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Add a delta rollup to a base rollup: measures are summed per key, missing ones count as 0."""
    union = base.unionByName(delta, allowMissingColumns=True)
    measures = [c for c in union.columns if c not in keys]
    kinds = dict(union.dtypes)

    def total(c: str) -> Column:
        filled = F.sum(F.coalesce(F.col(c), F.lit(0).cast(kinds[c])))
        return (filled.cast("decimal(38,10)") if kinds[c].startswith("decimal") else filled).alias(c)

    return union.groupBy(*keys).agg(*[total(c) for c in measures])


def merge_daily_models(base_daily: DataFrame, delta_daily: DataFrame, merged_usage: DataFrame) -> DataFrame:
    """Daily tokens and costs by model: base days are priced by ratio, delta days are exact."""
    return merge_rollup(allocate_costs(base_daily, merged_usage), delta_daily, ["date", "model"])


def merged_totals(base: DataFrame, usage: DataFrame, delta: DataFrame) -> DataFrame:
    """One row: counts of base and delta added; tokens and costs from the merged model usage."""
    counts = base.select("session_count", "message_count").unionByName(delta.select("session_count", "message_count"))
    tokens = usage.select(sum((F.coalesce(F.col(t), F.lit(0)) for t in TOKENS), F.lit(0)).alias("total_tokens"), *MICRO)
    both = counts.unionByName(tokens, allowMissingColumns=True)
    zero = F.lit(0).cast("bigint")
    return both.agg(
        *[F.coalesce(F.sum(c), zero).cast("bigint").alias(c) for c in ("session_count", "message_count", "total_tokens")],
        *[F.coalesce(F.sum(m).cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)")).alias(m) for m in MICRO],
    )


def merged_rollups(facts: DataFrame, turns: DataFrame, prices: DataFrame, base: dict[str, DataFrame], after: str | None) -> dict[str, DataFrame]:
    """Rollups of everything after the day ``after`` added to those of a base (see ``read_rollup_base``)."""
    delta = all_rollups(facts, turns, prices, after)
    usage = merge_rollup(price_usage(base["models"], prices), delta["models"], ["model"])
    return {
        "models": usage,
        "activity": merge_rollup(base["activity"], delta["activity"], ["date"]),
        "daily_models": merge_daily_models(base["daily_models"], delta["daily_models"], usage),
        "hours": merge_rollup(base["hours"], delta["hours"], ["hour"]),
        "totals": merged_totals(base["totals"], usage, delta["totals"]),
    }


def longest_session(sessions: DataFrame) -> DataFrame:
    """First session date and longest session, one row."""
    order = F.struct("duration_ms", F.col("session_id").alias("id"))
    best = F.max_by(F.struct("session_id", "duration_ms", "message_count", "started_at"), order)
    return sessions.agg(F.min("started_at").alias("first_started_at"), best.alias("longest")).select(
        "first_started_at", F.col("longest.session_id").alias("longest_session_id"),
        F.col("longest.duration_ms").alias("longest_duration_ms"),
        F.col("longest.message_count").alias("longest_message_count"),
    )
