from __future__ import annotations

import random

from logloom.operators import transcript as T
from logloom.sources.prices import default_prices

SCHEMA = "session_id string, seq long, role string, content string, timestamp string, tools array<struct<id:string,name:string>>, result_id string"


def frame(spark, messages, session="s"):
    rows = []
    for i, m in enumerate(messages):
        role, content, tools, answer = m
        rows.append((session, i, role, content, f"2026-05-03T10:00:{i % 60:02d}.000Z", [(t, t.upper()) for t in tools] or None, answer))
    return spark.createDataFrame(rows, SCHEMA)


def say(role, text="x", *tools):
    return role, text, tools, None


def use(*tools):
    return "tool-use", "", tools, None


def result(ident):
    return "tool-result", "", (), ident


def build(spark, messages, preset, span=1 << 20):
    grouped = T.assign_groups(T.filter_preset(frame(spark, messages), preset), span=span).cache()
    pairs = T.pair_tools(grouped, span=span)
    groups = T.transcript_groups(grouped, pairs)
    if preset == "tools":
        groups = T.merge_adjacent(groups, span=span)
    found = sorted([(r["group_id"], r["kind"], r["tool_pairs"]) for r in groups.collect()])
    return found, sorted([(r["use_seq"], r["tool_id"], r["result_seq"]) for r in pairs.collect()], key=str)


def test_tool_only_turns_collapse_once_hidden_events_are_filtered(spark):
    flow = [say("user"), use("read"), say("system"), use("grep"), say("system"), result("read"), result("grep")]
    groups, pairs = build(spark, flow, "tools")
    assert [g for g in groups if g[1] == "assistant"] == [(1, "assistant", 2)]
    assert pairs == [(1, "read", 5), (3, "grep", 6)]
    groups, pairs = build(spark, flow, "all")
    assert [g[1] for g in groups] == ["user", "assistant", "system", "assistant", "system", "assistant", "assistant"]
    assert pairs == sorted([(1, "read", None), (3, "grep", None), (None, "read", 5), (None, "grep", 6)], key=str)


def test_inline_calls_pair_across_hidden_events_only(spark):
    flow = [say("user"), say("assistant", "I will", "grep"), say("system"), result("grep")]
    assert build(spark, flow, "tools")[1] == [(1, "grep", 3)]
    groups, pairs = build(spark, flow, "all")
    assert pairs == [(None, "grep", 3)] and [g[1] for g in groups] == ["user", "assistant", "system", "assistant"]


def test_collapsed_run_of_three(spark):
    flow = [use("a"), result("a"), use("b"), result("b"), use("c"), result("c")]
    groups, pairs = build(spark, flow, "tools")
    assert groups == [(0, "assistant", 3)] and pairs == [(0, "a", 1), (2, "b", 3), (4, "c", 5)]


def test_usage_of_collapsed_groups(spark):
    flow = [say("user"), use("a"), result("a"), use("b"), result("b"), use("c"), result("c"), say("user"), say("assistant"), use("d"), say("assistant"), say("assistant")]
    spent = {1: ("m1", 100, 10), 3: ("m2", 200, 20), 5: ("m3", 300, 30), 8: ("m4", 1, 1), 9: ("m5", 7, 7), 10: ("m6", 2, 2), 11: ("m6", 5, 4)}
    parts = "input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, cache_5m_tokens long, cache_1h_tokens long"
    usage = spark.createDataFrame(
        [(seq, ident, "claude-opus-4-7", True, i, o, 0, 0, 0, 0, "standard") for seq, (ident, i, o) in spent.items()],
        f"seq long, message_id string, model string, has_usage boolean, {parts}, service_tier string",
    )
    grouped = T.assign_groups(T.filter_preset(frame(spark, flow), "tools"))
    merged = T.group_usage(grouped.join(usage, "seq", "left"), default_prices(spark))
    groups = T.with_usage(T.transcript_groups(grouped, T.pair_tools(grouped)), merged)
    out = {r["group_id"]: r for r in T.merge_adjacent(groups).collect()}
    tokens = lambda g: (out[g]["input_tokens"], out[g]["output_tokens"], out[g]["usage_messages"])
    # The last snapshot of a message counts; a call behind an assistant message is a step of it and adds nothing.
    assert tokens(1) == (600, 60, 3) and tokens(8) == (6, 5, 2) and out[0]["input_tokens"] is None
    assert float(out[1]["micro_api"]) == 600 * 5 + 60 * 25 and out[1]["service_tier"] == "standard"


def test_unanswered_call_after_an_assistant_takes_the_next_result(spark):
    flow = [say("assistant"), use("a"), result("other"), use("b"), result("b")]
    grouped = T.assign_groups(frame(spark, flow))
    got = {(r["use_seq"], r["result_seq"], r["by_position"]) for r in T.pair_tools(grouped).collect()}
    assert got == {(1, 2, True), (3, 4, False)}


def walk(messages):
    """Groups and pairs by walking the messages one after the other."""
    groups, pairs, i = {}, [], 0
    taken = set()
    is_flow = lambda m: m[0] in ("tool-use", "tool-result")

    def answer(tool, start):
        for j in range(start, len(messages)):
            if not is_flow(messages[j]):
                return None
            if j not in taken and messages[j][0] == "tool-result" and messages[j][3] == tool:
                taken.add(j)
                return j
        return None

    while i < len(messages):
        role, first = messages[i][0], i
        if role in ("assistant", "system", "command"):
            same = ("assistant",) if role == "assistant" else ("system", "command")
            while i < len(messages) and messages[i][0] in same:
                groups[i] = first
                i += 1
            if role != "assistant":
                continue
            for j in range(first, i):
                pairs += [(j, t, a) for t in messages[j][2] if (a := answer(t, i)) is not None]
            led = True
        elif role == "user":
            groups[i] = i
            i += 1
            continue
        elif role == "tool-result":
            groups[i] = i
            pairs.append((None, messages[i][3], i))
            i += 1
            continue
        else:
            led = False
        while i < len(messages) and is_flow(messages[i]):
            groups[i] = first
            if messages[i][0] == "tool-result":
                if i not in taken:
                    pairs.append((None, messages[i][3], i))
            else:
                for n, t in enumerate(messages[i][2]):
                    a = answer(t, i + 1)
                    if a is None and led and n == 0 and i + 1 < len(messages) and i + 1 not in taken and messages[i + 1][0] == "tool-result":
                        a = i + 1
                        taken.add(a)
                    pairs.append((i, t, a))
            i += 1
    return groups, sorted(pairs, key=str)


def test_groups_and_pairs_equal_the_walk(spark):
    rng = random.Random(11)
    flows = []
    for _ in range(60):
        flow = []
        for _ in range(40):
            role = rng.choice(["user", "assistant", "system", "tool-use", "tool-use", "tool-use", "tool-result", "tool-result", "tool-result"])
            tools = [rng.choice("abc")] if role == "tool-use" or (role == "assistant" and rng.random() < 0.5) else []
            flow.append((role, "x" if role != "tool-use" else "", tools, rng.choice("abc") if role == "tool-result" else None))
        flows.append(flow)
    df = None
    for n, flow in enumerate(flows):
        part = [(f"s{n}", i, r, c, None, [(t, t) for t in tools] or None, a) for i, (r, c, tools, a) in enumerate(flow)]
        df = part if df is None else df + part
    messages = spark.createDataFrame(df, SCHEMA)
    for span in (5, 1000):
        grouped = T.assign_groups(messages, span=span).cache()
        got_groups = {(r["session_id"], r["seq"]): r["group_id"] for r in grouped.collect()}
        got_pairs = {}
        for r in T.pair_tools(grouped, span=span).collect():
            got_pairs.setdefault(r["session_id"], []).append((r["use_seq"], r["tool_id"], r["result_seq"]))
        for n, flow in enumerate(flows):
            groups, pairs = walk(flow)
            assert {i: got_groups[f"s{n}", i] for i in groups} == groups, (n, span)
            assert sorted(got_pairs[f"s{n}"], key=str) == pairs, (n, span)


def test_markers_equal_the_pointer_walk(spark):
    rng = random.Random(4)
    groups, marks, want = [], [], {}
    for k in range(30):
        ranges = []
        for g in range(12):
            start = rng.randint(0, 100)
            ranges.append((g, start, start + rng.randint(0, 15)) if rng.random() < 0.8 else (g, None, None))
        times = sorted(rng.randint(0, 120) for _ in range(20))
        at = 0
        for g, a, b in ranges:
            if a is None:
                continue
            while at < len(times) and times[at] < a:
                want[k, at] = (g, "before")
                at += 1
            while at < len(times) and times[at] <= b:
                want[k, at] = (g, "inside")
                at += 1
        want.update({(k, m): (None, "tail") for m in range(at, len(times))})
        groups += [(k, g, a, b) for g, a, b in ranges]
        marks += [(k, m, x) for m, x in enumerate(times)]
    g = spark.createDataFrame(groups, "k int, group_id long, start_ms long, end_ms long")
    m = spark.createDataFrame(marks, "k int, marker_no long, at_ms long")
    got = {(r["k"], r["marker_no"]): (r["group_id"], r["placement"]) for r in T.place_markers(g, m, ["k"], 9).collect()}
    assert got == want


def test_markers_among_tool_pairs_equal_the_pointer_walk(spark):
    """The walk: markers before a pair's start stand before it, those up to its end after it, the rest behind all pairs."""
    rng = random.Random(6)
    stamp = lambda ms: None if ms is None else f"2026-05-03T10:{ms // 60:02d}:{ms % 60:02d}.000Z"
    base = 1777802400000  # 2026-05-03T10:00:00Z
    groups, pairs, marks, want = [], [], [], {}
    for k in range(40):
        start, steps = rng.randint(0, 20), []
        for n in range(rng.randint(0, 6)):
            a, b = (rng.randint(start, 90) if rng.random() < 0.7 else None for _ in range(2))
            use, result = (10 * n + 1 if rng.random() < 0.8 else None), 10 * n + 4
            steps.append((use, result if use is None or rng.random() < 0.8 else None, rng.randint(0, 1), a, b))
        known = [t for s in steps for t in s[3:] if t is not None]
        end = max([start + 5, *known])
        start = min([start, *known])
        groups.append((k, 7, "assistant" if k % 5 else "system", stamp(start), stamp(end), base + start * 1000, base + end * 1000))
        pairs += [(k, 7, u, p, r, stamp(a), stamp(b)) for u, r, p, a, b in steps]
        times = sorted(rng.randint(start, end) for _ in range(8))
        marks += [(k, m, base + x * 1000) for m, x in enumerate(times)]
        if not k % 5:
            continue
        at = 0
        for u, r, p, a, b in steps:
            have = [t for t in (a, b) if t is not None]
            low, high = (min(have), max(have)) if have else (start, start)
            place = (u if u is not None else r, p)
            while at < len(times) and times[at] < low:
                want[k, at] = (*place, "before")
                at += 1
            while at < len(times) and times[at] <= high:
                want[k, at] = (*place, "after")
                at += 1
        want.update({(k, m): (None, None, "end") for m in range(at, len(times))})
    g = spark.createDataFrame(groups, "k int, group_id long, kind string, start_at string, end_at string, start_ms long, end_ms long")
    p = spark.createDataFrame(pairs, "k int, group_id long, use_seq long, pos int, result_seq long, use_at string, result_at string")
    m = spark.createDataFrame(marks, "k int, marker_no long, at_ms long")
    placed = T.place_markers(g, m, ["k"], 9000)
    got = {(r["k"], r["marker_no"]): (r["step_seq"], r["step_pos"], r["step_side"]) for r in T.place_in_steps(placed, g, p, ["k"], 9000).collect()}
    assert got == want


def test_run_has_the_breakdown_of_its_last_visible_message(spark):
    flow = [say("user"), say("assistant", "one"), say("assistant", "two"), say("assistant", " "), say("user"), say("assistant", "three")]
    rows = frame(spark, flow).join(spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "seq long, total long"), "seq", "left")
    rows = rows.selectExpr("*", "if(total is null, null, struct(total)) as breakdown")
    got = {r["run_id"]: r["breakdown"] and r["breakdown"]["total"] for r in T.merge_runs(T.assign_groups(rows)).collect()}
    assert got == {1: 20, 5: None}


def test_merged_ids_name_the_joined_group(spark):
    rows = [("s", i, k) for i, k in enumerate(["user", "assistant", "assistant", "system", "assistant", "assistant", "user"])]
    g = spark.createDataFrame(rows, "session_id string, group_id long, kind string")
    for span in (2, 100):
        got = {r["group_id"]: r["merged_id"] for r in T.merged_ids(g, span=span).collect()}
        assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
