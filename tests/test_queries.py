"""A selection of registered queries against their SQL answers; tests/oracle_check.py runs them all."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "cost_by_model", "price_match", "collapsed_turns", "session_summary", "project_summary", "daily_activity", "merged_daily_models",
    "activity_heatmap", "extract_command", "path_functions", "tool_pairs", "transcript_groups", "compaction_markers", "running_context",
    "range_resolution", "merged_ranges", "change_summary", "session_messages", "tool_call_details", "message_block_details",
    "session_hunks", "file_change_list", "session_patches",
]


@pytest.fixture(scope="module")
def database():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, database, name):
    assert compare(spark, database, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[0] == "model"
    assert set(entry.oracle_sql()) <= set(entry.queries())
