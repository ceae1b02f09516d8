from __future__ import annotations

from logloom.plans.session_logs import dashboard
from logloom.sources.logs import read_rollup_base
from logloom.sources.prices import default_prices
from tests.logtree import assistant, tool_use, usage, user, write_session


def test_dashboard_of_a_log_tree(spark, tmp_path):
    text = [{"type": "text", "text": "x"}, tool_use("t", "Read", file_path="a")]
    write_session(tmp_path, "-p-a", "s1", [user("2026-01-02T10:00:00Z", "a", cwd="/w/alpha"), assistant("2026-01-02T10:00:09Z", text, "m1", "claude-opus-4-7", usage(1, 2, 3, 4))])
    write_session(tmp_path, "-p-b", "s2", [user("2026-01-03T23:59:59Z", "a"), user("2026-01-04T00:00:01Z", "b"), {"type": "user", "message": {"role": "user", "content": "no time"}}])
    out = {name: df.collect() for name, df in dashboard(spark, str(tmp_path), default_prices(spark)).items()}
    head = out["headline"][0]
    assert (head["session_count"], head["message_count"], head["total_tokens"], head["project_count"]) == (2, 4, 10, 2)
    assert (head["longest_session_id"], head["longest_duration_ms"], head["first_started_at"]) == ("s1", 9000, "2026-01-02T10:00:00Z")
    assert [r["session_id"] for r in out["recent_sessions"]] == ["s2", "s1"]
    assert {(r["project_id"], r["project_name"], r["session_count"], r["message_count"]) for r in out["projects"]} == {("-p-a", "alpha", 1, 2), ("-p-b", "b", 1, 3)}
    assert {(r["date"], r["message_count"], r["session_count"], r["tool_call_count"]) for r in out["daily_activity"]} == {
        ("2026-01-02", 2, 1, 1), ("2026-01-03", 1, 1, 0), ("2026-01-04", 1, 0, 0),
    }
    assert [(r["hour"], r["turn_count"]) for r in out["hours"]] == [(10, 1)]
    assert [(r["tool_name"], r["calls"]) for r in out["tool_usage"]] == [("Read", 1)]


def test_base_counts_where_old_logs_are_gone(spark, tmp_path):
    text = [{"type": "text", "text": "x"}]
    write_session(tmp_path, "-p-b", "s2", [user("2026-01-03T10:00:00Z", "a"), assistant("2026-01-03T10:00:09Z", text, "m1", "claude-opus-4-7", usage(1, 2, 3, 4))])
    (tmp_path / "stats-cache.json").write_text(
        '{"lastComputedDate":"2026-01-02","dailyActivity":[{"date":"2026-01-01","messageCount":7,"sessionCount":2,"toolCallCount":1}],'
        '"dailyModelTokens":[{"date":"2026-01-01","tokensByModel":{"claude-opus-4-7":10}}],"modelUsage":{"claude-opus-4-7":{"inputTokens":4,"outputTokens":3,'
        '"cacheReadInputTokens":2,"cacheCreationInputTokens":1}},"totalSessions":2,"totalMessages":7,"hourCounts":{"10":5},"firstSessionDate":"2026-01-01T08:00:00Z",'
        '"longestSession":{"sessionId":"gone","duration":60000,"messageCount":5}}'
    )
    made = dashboard(spark, str(tmp_path), default_prices(spark), read_rollup_base(spark, str(tmp_path)))
    out = {name: made[name].collect() for name in ("headline", "daily_activity", "models", "hours")}
    head = out["headline"][0]
    assert (head["session_count"], head["message_count"], head["project_count"], head["total_tokens"]) == (3, 9, 1, 10)
    assert (head["first_started_at"], head["longest_session_id"], head["longest_duration_ms"], head["longest_message_count"]) == ("2026-01-01T08:00:00Z", "gone", 60000, 5)
    assert {(r["date"], r["message_count"]) for r in out["daily_activity"]} == {("2026-01-01", 7), ("2026-01-03", 2)}
    assert [(r["model"], r["input_tokens"], r["output_tokens"]) for r in out["models"]] == [("claude-opus-4-7", 5, 5)]
    assert [(r["hour"], r["turn_count"]) for r in out["hours"]] == [(10, 6)]
