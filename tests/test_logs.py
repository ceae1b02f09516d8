from __future__ import annotations

import pathlib

from logloom.operators import context as C
from logloom.operators import messages as M
from logloom.operators import records as R
from logloom.operators import sessions as S
from logloom.operators import turns as TU
from logloom.operators.scans import chunk_of
from logloom.sources import logs
from logloom.sources.logs import list_files, read_history, read_records, read_rollup_base
from logloom.sources.prices import default_prices
from pyspark.sql import functions as F
from tests.logtree import assistant, tool_result, tool_use, usage, user, write_session


def summaries(spark, root):
    records = read_records(spark, str(root))
    tools = TU.turn_tools(R.extract_tool_uses(R.explode_blocks(records)).filter("top_level"))
    turns = TU.collapse_turns(R.snapshots(records))
    sessions = S.session_summary(R.record_facts(records), turns, tools, default_prices(spark))
    return {r["session_id"]: r for r in sessions.collect()}, turns


def test_drop_rules_and_line_order_of_a_split_file(spark, tmp_path):
    rows = [user("2026-01-01T00:00:00Z", f"text {i} é" + "x" * 50) for i in range(3000)]
    bad = ["", "   ", "{broken", '{"type":5}', '{"type":"user","timestamp":null}', '{"isMeta":"x"}', '{"message":[]}', "[1]", '"s"']
    write_session(tmp_path, "-p", "s", rows[:1500] + bad + rows[1500:])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = read_records(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        got = [r[0] for r in lines.orderBy("seq").select(F.get_json_object("line", "$.message.content")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [r["message"]["content"] for r in rows]


def test_turn_dedupe_and_subagents(spark, tmp_path):
    write_session(
        tmp_path, "-home-a", "s1",
        [
            user("2026-01-01T00:00:00Z", "go", cwd="/home/a", gitBranch="main", version="1"),
            assistant("2026-01-01T00:00:01Z", [tool_use("t1", "Read", file_path="a")], "m1", "claude-opus-4-7", usage(100, 20, 30, 40)),
            assistant("2026-01-01T00:00:02Z", [tool_use("t1", "Read", file_path="a")], "m1", "claude-opus-4-7", usage(100, 50, 30, 40)),
            assistant("2026-01-01T00:00:03Z", [{"type": "text", "text": "x"}], "m2", "<synthetic>", usage(5, 5, 0, 0)),
        ],
        {"a.jsonl": [assistant("2026-01-01T00:05:00Z", [tool_use("t9", "Bash", command="x")], "m1", "claude-haiku-4-5", usage(7, 3, 2, 11))]},
    )
    got, turns = summaries(spark, tmp_path)
    s = got["s1"]
    assert (s["assistant_count"], s["tool_count"], s["user_count"], s["message_count"]) == (2, 1, 1, 3)
    assert (s["input_tokens"], s["output_tokens"], s["cache_write_tokens"], s["cache_read_tokens"]) == (112, 58, 32, 51)
    assert s["model"] == "claude-opus-4-7" and s["duration_ms"] == 300_000 and s["git_branch"] == "main"
    assert {r["display_name"] for r in S.project_models(turns).collect()} == {"Opus", "Haiku", "Synthetic"}
    names = S.project_names(R.record_facts(read_records(spark, str(tmp_path)))).first()
    assert (names["project_name"], names["project_path"]) == ("a", "/home/a")
    assert list_files(spark, str(tmp_path)).count() == 2


def test_hidden_thinking_cache_write_is_recovered(spark, tmp_path):
    hidden = [{"type": "thinking", "thinking": "", "signature": "s"}]
    write_session(tmp_path, "-p", "s", [
        assistant("2026-01-01T00:00:01Z", hidden, "m", use=usage(10, 15, 120, 25)),
        assistant("2026-01-01T00:00:02Z", [{"type": "text", "text": "done"}], "m", use=usage(10, 15, 120, 25), stop="end_turn"),
    ])
    got, _ = summaries(spark, tmp_path)
    s = got["s"]
    assert s["assistant_count"] == 1 and s["cache_write_tokens"] == 240
    assert s["input_tokens"] + s["output_tokens"] + s["cache_write_tokens"] + s["cache_read_tokens"] == 290


def test_image_payload_does_not_count(spark, tmp_path):
    image = {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "A" * 20_000}}
    write_session(tmp_path, "-p", "s", [
        user("2026-01-01T00:00:00Z", [{"type": "text", "text": "look"}, image]),
        assistant("2026-01-01T00:00:01Z", [{"type": "thinking", "thinking": "", "signature": "s"}], "m1", use=usage(80, 1, 40, 200)),
        user("2026-01-01T00:00:02Z", "and"),
        assistant("2026-01-01T00:00:03Z", [{"type": "text", "text": "ok"}], "m2", use=usage(80, 1, 40, 200)),
    ])
    given = C.prompt_contributions(read_records(spark, str(tmp_path)))
    keys = ["project_id", "session_id"]
    ctx = C.running_context(given, keys, "seq", chunk_of(F.col("seq"), 2), F.col("type") == "assistant", [*C.BUCKETS, "hidden_thinking"])
    out = C.prompt_breakdown(ctx.filter("type = 'assistant'"))
    last = out.orderBy(F.desc("seq")).first()
    assert last["total_tokens"] == 320 and last["other_tokens"] < 1000 and not last["overflow"]
    # Hidden thinking was seen, so the unexplained rest is thinking.
    assert last["thinking_tokens"] > 200
    parts = {r["segment"] for r in C.window_snapshot(out, keys).collect()}
    assert {"conversation", "thinking", "other"} == parts


def test_command_roles(spark, tmp_path):
    write_session(tmp_path, "-p", "s", [
        user("1", "<command-name>/clear</command-name>\n<command-args> now </command-args>"),
        user("2", "<local-command-stdout>\x1b[1mhi\x1b[0m </local-command-stdout>"),
        user("3", "<command-name>n</command-name><local-command-caveat>care</local-command-caveat>"),
    ])
    rows = M.classify_messages(read_records(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r["role"], r["content"], r["is_meta"]) for r in rows] == [("command", "/clear now", False), ("command", "hi", False), ("command", "care", True)]


def test_tool_details_previews_and_results(spark, tmp_path):
    write_session(tmp_path, "-p", "s", [
        assistant("1", [
            tool_use("a", "Read", file_path="C:\\repo\\src\\index.ts", startLine=10, endLine=22, ignored="later"),
            {"type": "tool_use", "id": "b", "name": "Bash", "input": "npm test"},
            tool_use("c", "Glob", paths=["src/a.ts", "src/b.ts"]),
            tool_use("d", "Write", file_path="a.txt", content="one\ntwo\nthree"),
            tool_use("e", "Edit", file_path="src/app.ts", startLine=7, old_string="const oldValue = true;", new_string="const newValue = true;"),
            tool_use("f", "Edit", file_path="x", old_string="", new_string="only new"),
        ]),
        user("2", [tool_result("a", [{"text": "first"}, {"tool_name": "Read"}]), tool_result("b", "second")],
             toolUseResult={"type": "readFile", "content": {"file": {"filePath": "src/app.ts", "totalLines": 9, "deep": {"x": 1}}}, "empty": None}),
        user("3", [], toolUseResult={"stdout": " out "}),
    ])
    records = read_records(spark, str(tmp_path))
    calls = {r["tool_id"]: r for r in M.tool_calls(records).collect()}
    pairs = lambda r: [(d["label"], d["value"]) for d in r["details"]]
    assert pairs(calls["a"]) == [("File", "C:\\repo\\src\\index.ts"), ("Start line", "10"), ("End line", "22"), ("Ignored", "later")]
    assert calls["a"]["summary"] == "C:\\repo\\src\\index.ts (10-22)"
    assert pairs(calls["b"]) == [("Input", "npm test")] and calls["b"]["summary"] == "npm test"
    assert pairs(calls["c"]) == [("Paths", "src/a.ts src/b.ts")]
    assert pairs(calls["d"]) == [("File", "a.txt"), ("Content", "3 lines")]
    assert (calls["e"]["old_text"], calls["e"]["location"]) == ("const oldValue = true;", "line 7")
    assert calls["f"]["old_text"] is None
    blocks = M.message_blocks(records).orderBy("seq", "pos").collect()
    first, second, bare = blocks
    assert first["title"] == "Read File" and first["content"] == "first, Read"
    assert [(d["key"], d["value"]) for d in first["details"]] == [
        ("tool_use_id", "a"), ("type", "readFile"), ("content.file.filePath", "src/app.ts"), ("content.file.totalLines", "9"), ("content.file.deep", "1 fields"),
    ]
    assert second["title"] == "Tool Result" and second["content"] == "second" and second["tool_id"] == "b"
    assert bare["content"] == "out" and bare["tool_id"] is None


def test_base_and_history_files(spark, tmp_path):
    (tmp_path / "stats-cache.json").write_text(
        '{"version":1,"lastComputedDate":"2026-01-02","dailyActivity":[{"date":"2026-01-01","messageCount":3,"sessionCount":1,"toolCallCount":2}],'
        '"dailyModelTokens":[{"date":"2026-01-01","tokensByModel":{"m.1":10,"n":5}}],"modelUsage":{"m.1":{"inputTokens":4,"outputTokens":3,"cacheReadInputTokens":2,"cacheCreationInputTokens":1}},'
        '"totalSessions":1,"totalMessages":3,"hourCounts":{"9":2,"10":1},"firstSessionDate":"2026-01-01","longestSession":{"sessionId":"a","duration":5}}'
    )
    base = read_rollup_base(spark, str(tmp_path))
    assert [tuple(r) for r in base["daily_models"].orderBy("model").collect()] == [("2026-01-01", "m.1", 10), ("2026-01-01", "n", 5)]
    assert base["models"].first().asDict() == {"model": "m.1", "input_tokens": 4, "output_tokens": 3, "cache_write_tokens": 1, "cache_read_tokens": 2}
    assert {tuple(r) for r in base["hours"].collect()} == {(9, 2), (10, 1)}
    assert base["totals"].first()["longest_duration_ms"] == 5
    (tmp_path / "history.jsonl").write_text('{"display":"a","timestamp":1000,"project":"p"}\nbroken\n\n')
    assert [(r["display"], r["at"].year) for r in read_history(spark, str(tmp_path)).collect()] == [("a", 1970)]


def test_project_folder_is_the_one_below_the_root(spark):
    from logloom.sources.logs import with_path_dims

    paths = ["/a/projects/x/projects/p/s.jsonl", "/a/projects/x/projects/p/s/subagents/projects/q/y.jsonl"]
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    got = [(r.project_id, r.session_id, r.top_level) for r in with_path_dims(df, "file:/a/projects/x").orderBy("file_path").collect()]
    assert got == [("p", "s", True), ("p", "s", False)]
    free = spark.createDataFrame([("/r/projects/p/s/subagents/projects/q/y.jsonl",)], "file_path string")
    assert [(r.project_id, r.session_id, r.top_level) for r in with_path_dims(free).collect()] == [("p", "s", False)]


def test_long_and_deep_lines_are_kept_and_rejects_are_listed(spark):
    long = '{"type":"user","message":{"role":"user","content":"' + "x" * 40_000_000 + '"}}'
    deep = '{"type":"user","extra":' + "[" * 1200 + "]" * 1200 + "}"
    lines = [long, deep, "{broken", '{"type":5}', '{"message":[]}', "[1]", "  ", '{"type":null}', '{"isMeta":true}']
    rows = [(line, "/logs/projects/p/s.jsonl", i, "p", "s", True) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "value string, file_path string, seq long, project_id string, session_id string, top_level boolean")
    kept = logs.parse_envelope(df).select("seq", F.length(F.expr("try_variant_get(message, '$.content', 'string')")).alias("n"))
    assert sorted((r["seq"], r["n"]) for r in kept.collect()) == [(0, 40_000_000), (1, None), (8, None)]
    bad = {r["seq"]: (r["reason"], r["bytes"]) for r in logs.rejected_lines(df).collect()}
    assert bad == {2: ("unparsable", 7), 3: ("wrong type", 10), 4: ("wrong type", 14), 5: ("wrong type", 3), 7: ("wrong type", 13)}
