"""From parsed log records to session, project and dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import records as R
from logloom.operators import rollups, sessions
from logloom.operators import turns as TU
from logloom.plans.dashboard import headline_stats
from logloom.session import cut_lineage
from logloom.sources.logs import list_files, read_records


def summarise_logs(records: DataFrame, prices: DataFrame) -> DataFrame:
    """Session summaries of parsed records; the JSON is parsed once."""
    slim = cut_lineage(R.log_facts(records))
    turns = cut_lineage(TU.collapse_turns(R.snapshots_of(slim)))
    return sessions.session_summary(R.facts_of(slim), turns, TU.turn_tools(R.tool_uses_of(slim)), prices)


def dashboard(spark: SparkSession, root: str, prices: DataFrame, base: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All dashboard tables of a log tree: headline, recent sessions, projects, daily, models, hours.

    With ``base`` (see ``read_rollup_base``) days up to its last date count as the base has them, even where their logs
    are gone, and logs only for later days. Sessions and projects are always those of the logs.
    """
    slim = cut_lineage(R.log_facts(read_records(spark, root)))
    facts = R.facts_of(slim)
    tools = TU.turn_tools(R.tool_uses_of(slim))
    turns = cut_lineage(TU.with_tool_counts(TU.collapse_turns(R.snapshots_of(slim)), tools))
    summary = cut_lineage(sessions.session_summary(facts, turns, tools, prices))
    return dashboard_tables(facts, turns, tools, summary, list_files(spark, root), prices, base)


def dashboard_tables(
    facts: DataFrame, turns: DataFrame, tools: DataFrame, summary: DataFrame, files: DataFrame, prices: DataFrame, base: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """The tables of :func:`dashboard` from record facts, turns with tool counts, tool calls, session summaries and files."""
    if base is None:
        rolled = rollups.all_rollups(facts, turns, prices)
    else:
        last = base["totals"].agg(F.max("last_date")).first()[0]  # one row of the base file
        rolled = rollups.merged_rollups(facts, turns, prices, base, last)
    return {
        "headline": headline_stats(summary, rolled["totals"], base["totals"] if base else None),
        "recent_sessions": sessions.list_sessions(summary, limit=10),
        "projects": sessions.project_summary(summary, files)
        .join(sessions.project_names(facts), "project_id", "left").orderBy(F.desc_nulls_last("last_active"), "project_id"),
        "project_models": sessions.project_models(turns),
        "daily_activity": rolled["activity"],
        "daily_models": rolled["daily_models"],
        "models": rolled["models"],
        "hours": rolled["hours"],
        "tool_usage": sessions.tool_usage(tools),
    }
