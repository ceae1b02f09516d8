"""Headline numbers of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import non_empty
from logloom.operators.pricing import MICRO, TOKENS
from logloom.operators.rollups import longest_session


def _with_base(longest: DataFrame, base: DataFrame) -> DataFrame:
    """The earlier first session and the longer longest session of the logs and a base."""
    names = ("longest_session_id", "longest_duration_ms", "longest_message_count")
    both = longest.unionByName(base.select(non_empty(F.col("first_session_date")).alias("first_started_at"), *names))
    order = F.when(non_empty(F.col("longest_session_id")).isNotNull(), F.struct("longest_duration_ms", "longest_session_id"))
    best = F.max_by(F.struct(*names), order)
    return both.agg(F.min("first_started_at").alias("first_started_at"), best.alias("best")).select("first_started_at", "best.*")


def headline_stats(sessions: DataFrame, totals: DataFrame, base_totals: DataFrame | None = None) -> DataFrame:
    """One row: totals, project count, first session, longest session, costs.

    ``totals`` is from :func:`rollups.totals`, or :func:`rollups.merged_totals` where there is a base; ``base_totals``
    is the base's row, whose first and longest session count too, as their logs may be gone. Tokens and costs
    come from the sessions where those are above zero.
    """
    whole = sessions.agg(
        F.count_distinct("project_id").alias("project_count"),
        F.sum(sum((F.col(t) for t in TOKENS), F.lit(0))).alias("session_tokens"),
        *[F.sum(m).cast("decimal(38,10)").alias(f"session_{m}") for m in MICRO],
    )
    longest = longest_session(sessions)
    if base_totals is not None:
        longest = _with_base(longest, base_totals)
    rows = totals.unionByName(whole, allowMissingColumns=True).unionByName(longest, allowMissingColumns=True)
    # One row per source; every column has a single value.
    out = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    own = F.col("session_micro_api") > 0
    return out.select(
        "session_count", "message_count",
        F.when(F.col("session_tokens") > 0, F.col("session_tokens")).otherwise(F.col("total_tokens")).alias("total_tokens"),
        "project_count", "first_started_at", "longest_session_id", "longest_duration_ms", "longest_message_count",
        *[F.when(own, F.col(f"session_{m}")).otherwise(F.col(m)).alias(m) for m in MICRO],
    )
