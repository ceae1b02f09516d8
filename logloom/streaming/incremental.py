"""Incremental refresh: which sessions changed, and rollups of the delta merged into a base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import records as R
from logloom.operators import rollups, turns as TU
from logloom.session import cut_lineage
from logloom.sources.logs import parse_envelope, read_lines, with_path_dims

KEY = ["project_id", "session_id"]


def changed_sessions(files: DataFrame, seen: DataFrame | None = None, after_date: str | None = None) -> DataFrame:
    """Sessions with a new or changed file (own or sub-agent's).

    ``files`` and ``seen`` carry file_path and signature (change time and size). With ``after_date``
    a session counts when any of its files changed after the end of that day.
    """
    fresh = files
    if seen is not None:
        fresh = fresh.join(seen.select("file_path", "signature"), ["file_path", "signature"], "left_anti")
    if after_date:
        fresh = fresh.filter(F.col("modified_at") > F.lit(f"{after_date}T23:59:59Z").cast("timestamp"))
    return fresh.select(*KEY).distinct()


def turns_with_tools(slim: DataFrame) -> DataFrame:
    """Collapsed turns with their number of distinct tool calls, from :func:`records.log_facts`."""
    return TU.with_tool_counts(TU.collapse_turns(R.snapshots_of(slim)), TU.turn_tools(R.tool_uses_of(slim)))


def refresh_rollups(spark: SparkSession, root: str, prices: DataFrame, base: dict[str, DataFrame], after_date: str) -> dict[str, DataFrame]:
    """Rollups of everything after ``after_date`` added to a base (see ``read_rollup_base``).

    Only files changed since then are read, and they are parsed once. Totals are those of the base and the delta.
    """
    # A line dated later stands in a file changed later, so whole files are left out and no line is shuffled.
    lines = with_path_dims(read_lines(spark, root, f"{after_date}T23:59:59"), root)
    slim = cut_lineage(R.log_facts(parse_envelope(lines)))
    facts, turns = R.facts_of(slim), cut_lineage(turns_with_tools(slim))
    return rollups.merged_rollups(facts, turns, prices, base, after_date)
