"""Chunked scans and closed forms against direct folds, with chunks small enough to matter."""

from __future__ import annotations

import random

from logloom.operators import files as FI
from logloom.operators import turns as TU
from logloom.operators.context import running_context
from logloom.operators.scans import chunk_of, number_runs, running_extreme, running_sum
from logloom.sources.prices import default_prices
from pyspark.sql import functions as F


def rows(n_keys=6, n=40, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n_keys):
        for i in sorted(rng.sample(range(200), n)):
            out.append((f"k{k}", i, rng.choice("aab"), rng.randint(-5, 9)))
    return out


def test_running_sum_extreme_and_runs(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, seq long, label string, v int")
    chunk = chunk_of(F.col("seq"), 7)
    out = running_sum(df, ["k"], ["seq"], chunk, {"total": F.col("v")})
    out = running_extreme(out, ["k"], ["seq"], chunk, "low", F.col("v"), kind="min", inclusive=False)
    out = number_runs(out, ["k"], "seq", chunk, F.col("label"), F.col("label") == "b")
    got = {(r["k"], r["seq"]): (r["total"], r["low"], r["run_no"]) for r in out.collect()}
    state = {}
    for k, seq, label, v in data:
        total, low, prev, run = state.get(k, (0, None, None, 0))
        run += prev is None or label != prev or label == "b"
        assert got[k, seq] == (total + v, low, run)
        state[k] = (total + v, v if low is None else min(low, v), label, run)
    assert len(got) == len(data)


def test_running_context_skips_its_own_run(spark):
    data = rows(seed=2)
    df = spark.createDataFrame(data, "k string, seq long, label string, v int").withColumn("v", F.abs("v"))
    for span in (3, 50, 1000):
        out = running_context(df, ["k"], "seq", chunk_of(F.col("seq"), span), F.col("label") == "a", ["v"])
        got = {(r["k"], r["seq"]): r["ctx_v"] for r in out.collect()}
        state = {}
        for k, seq, label, v in data:
            total, pending = state.get(k, (0, 0))
            if label != "a":
                total, pending = total + pending, 0
            assert got[k, seq] == total, (k, seq, span)
            state[k] = (total, pending + abs(v)) if label == "a" else (total + abs(v), pending)


def test_recovered_cache_writes_match_the_fold(spark):
    rng = random.Random(5)
    data, want = [], {}
    for turn in range(400):
        pending = extra = 0
        seen = False
        last = None
        for i in sorted(rng.sample(range(40), rng.randint(1, 7))):
            used, think, shown = rng.random() < 0.8, rng.random() < 0.6, rng.random() < 0.7
            stop = rng.choice(["end_turn", "tool_use", None])
            write = rng.randint(0, 9)
            data.append(("p", "s", "f", f"t{turn}", i, True, "2026", "m", used, 1, 1, write if used else None, 1, think, shown and not think, stop))
            if not used:
                continue
            if think and not seen:
                pending = write
            else:
                if shown and not think and stop == "end_turn" and not seen and pending > 0:
                    extra += pending
                seen = seen or not think
                pending = 0
            last = write
        want[f"t{turn}"] = None if last is None else last + extra
    schema = ("project_id string, session_id string, file_path string, turn_key string, seq long, top_level boolean, timestamp string, model string, "
              "has_usage boolean, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, thinking_only boolean, visible boolean, stop_reason string")
    df = spark.createDataFrame(data, schema)
    for span in (4, 1000):
        got = {r["turn_key"]: r["cache_write_tokens"] for r in TU.collapse_turns(df, span).collect()}
        assert got == want


def test_usage_merge(spark):
    schema = ("g string, seq long, message_id string, model string, has_usage boolean, input_tokens long, output_tokens long, cache_write_tokens long, "
              "cache_read_tokens long, cache_5m_tokens long, cache_1h_tokens long, service_tier string")
    data = [
        ("a", 0, "1", None, True, 100, 20, 10, 30, 12, 4, "standard"), ("a", 1, "1", None, True, 100, 25, 20, 40, 12, 4, "standard"),
        ("a", 2, "2", None, True, 7, 3, 2, 1, 3, 9, "batch"), ("b", 0, "x", None, False, None, None, None, None, None, None, None),
    ]
    got = TU.merge_usage(spark.createDataFrame(data, schema), default_prices(spark), ["g"]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["input_tokens"], r["output_tokens"], r["cache_write_tokens"], r["cache_read_tokens"], r["service_tier"]) == (107, 28, 22, 41, "batch")
    assert (r["cache_5m_tokens"], r["cache_1h_tokens"], r["micro_api"]) == (15, 13, 0)


def test_ranges(spark):
    schema = "start long, end long, loaded long"
    built = spark.createDataFrame([(800, None, 200), (None, 999, 200), (12, 4, None), (None, None, 5), (3, None, None)], schema)
    got = [r[0] for r in built.select(FI.build_range(F.col("start"), F.col("end"), F.col("loaded"))).collect()]
    assert [None if g is None else tuple(g) for g in got] == [(800, 999), (800, 999), (4, 12), None, None]
    ranges = spark.createDataFrame([("f", 50, 75), ("f", 74, 90), ("f", 120, 125), ("f", 126, 130), ("f", 995, 1010)], "k string, start long, end long")
    merged = FI.merge_ranges(FI.clamp_ranges(ranges, F.lit(1000)), ["k"], span=10)
    assert sorted(tuple(r)[1:] for r in merged.collect()) == [(50, 90), (120, 130), (995, 1000)]


def test_range_union_covers_the_same_lines(spark):
    rng = random.Random(3)
    data = [(f"k{rng.randint(0, 3)}", s := rng.randint(1, 300), s + rng.randint(0, 12)) for _ in range(200)]
    merged = FI.merge_ranges(spark.createDataFrame(data, "k string, start long, end long"), ["k"], span=16).collect()
    cover = lambda rows: {(k, i) for k, a, b in rows for i in range(a, b + 1)}
    assert cover(data) == cover([tuple(r) for r in merged])
    ends = sorted((r["k"], r["start"], r["end"]) for r in merged)
    assert all(a[0] != b[0] or b[1] > a[2] + 1 for a, b in zip(ends, ends[1:]))


def test_scan_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame(rows(), "k string, seq long, label string, v int")
    df = df.mapInPandas(count, df.schema)
    chunk = chunk_of(F.col("seq"), 7)
    out = running_sum(df, ["k"], ["seq"], chunk, {"total": F.col("v")})
    out = running_extreme(out, ["k"], ["seq"], chunk, "low", F.col("v"))
    assert out.count() == len(rows()) and seen.value == len(rows())
