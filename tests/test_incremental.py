from __future__ import annotations

import os

import pytest

from logloom.operators.pricing import MICRO
from logloom.sources.datasets import dataset_counts, export_dataset, import_dataset, read_dataset
from logloom.sources.logs import list_files, parse_envelope, read_rollup_base, with_path_dims
from logloom.sources.prices import default_prices
from logloom.streaming.activity import read_chunks, run_once, stream_activity
from logloom.streaming.incremental import changed_sessions, refresh_rollups
from tests.logtree import assistant, usage, user, write_session


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "logs"
    old, new = "2026-01-02T10:00:00Z", "2026-01-03T09:30:00Z"
    text = [{"type": "text", "text": "x"}]
    write_session(root, "-p-a", "s1", [user(old, "a"), assistant(old, text, "m1", "claude-opus-4", usage(1, 2, 3, 4))])
    write_session(
        root, "-p-b", "s2",
        [user(old, "a"), user(new, "b"), assistant(new, text, "m2", "claude-opus-4", usage(10, 20, 30, 40)), assistant(new, text, "m2", "claude-opus-4", usage(10, 25, 30, 40))],
        {"x/y.jsonl": [assistant("2026-01-03T11:00:00Z", text, "m3", "claude-haiku-4-5", usage(5, 5, 5, 5))]},
    )
    (root / "projects" / "-empty").mkdir()
    old_time = 1767312000  # 2026-01-02
    os.utime(root / "projects" / "-p-a" / "s1.jsonl", (old_time, old_time))
    (root / "stats-cache.json").write_text(
        '{"lastComputedDate":"2026-01-02","dailyActivity":[{"date":"2026-01-02","messageCount":3,"sessionCount":2,"toolCallCount":0}],'
        '"dailyModelTokens":[{"date":"2026-01-02","tokensByModel":{"claude-opus-4":10}}],"modelUsage":{"claude-opus-4":{"inputTokens":1,"outputTokens":2,'
        '"cacheReadInputTokens":4,"cacheCreationInputTokens":3}},"totalSessions":2,"totalMessages":3,"hourCounts":{"9":1,"10":1}}'
    )
    return root


def test_changed_sessions(spark, tree):
    files = list_files(spark, str(tree))
    ids = lambda df: sorted(r["session_id"] for r in df.collect())
    assert ids(changed_sessions(files)) == ["s1", "s2"]
    assert ids(changed_sessions(files, after_date="2026-01-02")) == ["s2"]
    seen = files.filter("file_path not like '%y.jsonl'")
    assert ids(changed_sessions(files, seen)) == ["s2"] and ids(changed_sessions(files, files)) == []


def test_delta_is_merged_into_the_base(spark, tree):
    out = refresh_rollups(spark, str(tree), default_prices(spark), read_rollup_base(spark, str(tree)), "2026-01-02")
    activity = {r["date"]: (r["message_count"], r["session_count"]) for r in out["activity"].collect()}
    assert activity == {"2026-01-02": (3, 2), "2026-01-03": (2, 1)}
    models = {r["model"]: (r["input_tokens"], r["output_tokens"], r["cache_write_tokens"], r["cache_read_tokens"]) for r in out["models"].collect()}
    assert models == {"claude-opus-4": (11, 27, 33, 44), "claude-haiku-4-5": (5, 5, 5, 5)}
    assert {r["hour"]: r["turn_count"] for r in out["hours"].collect()} == {9: 2, 10: 1, 11: 1}
    days = {(r["date"], r["model"]): (r["tokens"], float(r[MICRO[0]])) for r in out["daily_models"].collect()}
    usage_cost = {r["model"]: float(r[MICRO[0]]) for r in out["models"].collect()}
    # The base day is priced by the model's average cost per token.
    assert days["2026-01-02", "claude-opus-4"] == (10, pytest.approx(usage_cost["claude-opus-4"] * 10 / 115, abs=1e-3))
    assert days["2026-01-03", "claude-opus-4"][0] == 105
    # Two sessions of the base and one of the delta.
    assert out["totals"].first()["session_count"] == 3


def test_export_and_import(spark, tree, tmp_path):
    export_dataset(spark, str(tree), str(tmp_path / "out"), "here")
    manifest = import_dataset(spark, str(tmp_path / "out"), str(tmp_path / "in")).first()
    assert (manifest["project_count"], manifest["session_count"], manifest["file_count"], manifest["exported_from"]) == (2, 2, 3, "here")
    live = dataset_counts(spark, str(tree)).first()
    assert (live["file_count"], live["total_bytes"]) == (3, manifest["total_bytes"])
    again = parse_envelope(with_path_dims(read_dataset(spark, str(tmp_path / "in"))))
    assert again.count() == 7 and again.filter("top_level").count() == 6
    with pytest.raises(Exception):
        import_dataset(spark, str(tree), str(tmp_path / "in"))


def test_stream_counts_each_turn_once(spark, tmp_path):
    chunks, out, state = tmp_path / "chunks", tmp_path / "out", tmp_path / "state"
    text = [{"type": "text", "text": "x"}]
    line = lambda ts, ident: assistant(ts, text, ident, use=usage(1, 1, 1, 1))
    write_session(chunks, "-p", "s1", [line("2026-01-01T10:00:00Z", "a"), line("2026-01-01T10:00:05Z", "a"), line("2026-01-01T11:00:00Z", "b"), user("2026-01-01T11:00:00Z", "u")])
    run_once(stream_activity(read_chunks(spark, str(chunks))), str(out), str(state)).awaitTermination(60)
    write_session(chunks, "-p", "s2", [line("2026-01-05T10:00:00Z", "c")])
    for _ in range(2):
        run_once(stream_activity(read_chunks(spark, str(chunks))), str(out), str(state)).awaitTermination(60)
    rows = spark.read.parquet(str(out)).collect()
    assert [(r["start"].isoformat(), r["turn_count"]) for r in rows] == [("2026-01-01T00:00:00", 2)]
