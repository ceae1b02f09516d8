"""Chart-ready tables: spines filled with zeros, shares and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.models import model_display
from logloom.operators.pricing import TOKENS, pick_cost, usd_rounded

WEEKS = 24
METRICS = {"messages": "message_count", "sessions": "session_count", "tool_calls": "tool_call_count"}


def activity_heatmap(daily: DataFrame, today: Column) -> DataFrame:
    """24 weeks of days from a Sunday, zero-filled, with a level 0-4 relative to the busiest day.

    ``today`` is a date expression evaluated once over ``daily`` (a literal, or ``max(date)``).
    """
    # Sunday of the week 23 weeks before today; dayofweek is 1 on Sundays.
    bounds = daily.agg(today.alias("today"), F.max("message_count").alias("top"))
    back = F.col("today") - F.make_interval(weeks=F.lit(WEEKS - 1))
    start = F.date_sub(back.cast("date"), F.dayofweek(back.cast("date")) - 1)
    spine = bounds.select(
        "today", F.greatest(F.coalesce("top", F.lit(1)), F.lit(1)).alias("top"),
        F.explode(F.sequence(start, F.date_add(start, WEEKS * 7 - 1))).alias("day"),
    ).withColumn("date", F.date_format("day", "yyyy-MM-dd"))
    count = F.coalesce("message_count", F.lit(0))
    ratio = count / F.col("top")
    level = F.when(count == 0, 0).when(ratio < 0.25, 1).when(ratio < 0.5, 2).when(ratio < 0.75, 3).otherwise(4)
    return spine.join(daily.select("date", "message_count"), "date", "left").select(
        "date", F.dayofweek("day").alias("weekday"), count.alias("message_count"), level.alias("level"),
        (F.col("day") > F.col("today")).alias("is_future"),
    )


def peak_hours(hours: DataFrame) -> DataFrame:
    """All 24 hours with a label 12a ... 11p and the turn count, zero-filled."""
    spine = hours.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    h = F.col("hour")
    label = (
        F.when(h == 0, F.lit("12a")).when(h < 12, F.concat(h.cast("string"), F.lit("a")))
        .when(h == 12, F.lit("12p")).otherwise(F.concat((h - 12).cast("string"), F.lit("p")))
    )
    return spine.join(hours, "hour", "left").select(
        "hour", label.alias("label"), F.coalesce("turn_count", F.lit(0)).alias("turn_count")
    )


def usage_over_time(daily: DataFrame, metric: str = "messages") -> DataFrame:
    """One metric per day with a short day label."""
    day = F.col("date").cast("date")
    return daily.select("date", F.date_format(day, "MMM d").alias("label"), F.col(METRICS[metric]).alias("value")).orderBy("date")


def model_share(usage: DataFrame, mode: str | None = None) -> DataFrame:
    """Tokens, cost and percent of all tokens per model."""
    tokens = sum((F.col(t) for t in TOKENS), F.lit(0))
    rows = usage.select("model", model_display(F.col("model")).alias("display_name"), tokens.alias("tokens"), usd_rounded(pick_cost(mode)).alias("cost"))
    total = rows.agg(F.sum("tokens").alias("total")).select(F.lit(1).alias("one"), "total")
    share = F.when(F.col("total") > 0, F.floor((F.col("tokens") * 200 + F.col("total")) / (F.col("total") * 2))).otherwise(0)
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("model", "display_name", "tokens", "cost", share.cast("bigint").alias("percent"))
