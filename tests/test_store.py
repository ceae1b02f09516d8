from __future__ import annotations

import os

import pytest

from logloom.plans.session_logs import dashboard
from logloom.sources import versions
from logloom.sources.prices import default_prices
from logloom.streaming import store as ST
from logloom.streaming.activity import read_chunk_lines, store_stream
from tests.logtree import assistant, tool_use, usage, user, write_session

TEXT = [{"type": "text", "text": "x"}]


def lines(day, n, ident):
    out = []
    for i in range(n):
        at = f"2026-01-0{day}T10:{i:02}:00Z"
        out += [user(at, f"q {i}", cwd="/w"), assistant(at, TEXT, f"{ident}{i}", use=usage(i, 1, 2, 3)), assistant(at, TEXT + [tool_use(f"t{i}", "Bash", command="ls")], f"{ident}{i}", use=usage(i, 5, 2, 3))]
    return out


def build(root):
    write_session(root, "-p-a", "s1", lines(1, 3, "a"))
    write_session(root, "-p-a", "s2", lines(2, 2, "b"), {"x/y.jsonl": lines(3, 1, "c")})
    write_session(root, "-p-b[1]", "s 3%20", lines(4, 4, "d"))
    return str(root)


def rows(df, drop=()):
    return sorted((tuple(str(r[c]) for c in sorted(df.columns) if c not in drop) for r in df.collect()))


def same(spark, root, folder, prices):
    """The stored dashboard equals that of a full run."""
    full, stored = dashboard(spark, root, prices), ST.stored_dashboard(spark, folder, prices)
    assert full.keys() == stored.keys()
    for name in full:
        assert full[name].columns == stored[name].columns and rows(full[name]) == rows(stored[name]), name


def test_two_refreshes_read_changed_files_only(spark, tmp_path):
    root, folder, prices = build(tmp_path / "logs"), str(tmp_path / "store"), default_prices(spark)
    first = ST.refresh_tree(spark, root, folder, prices)
    same(spark, root, folder, prices)
    assert ST.refresh_tree(spark, root, folder, prices).number == first.number
    # An unchanged file is not opened: its content is spoilt under the same size and time.
    quiet = tmp_path / "logs/projects/-p-a/s1.jsonl"
    before, text = os.stat(quiet), quiet.read_bytes()
    quiet.write_bytes(b"#" * len(text))
    os.utime(quiet, ns=(before.st_atime_ns, before.st_mtime_ns))
    write_session(tmp_path / "logs", "-p-a", "s2", lines(2, 5, "b"))
    write_session(tmp_path / "logs", "-p-c", "s9", lines(5, 1, "e"))
    os.remove(tmp_path / "logs/projects/-p-b[1]/s 3%20.jsonl")
    second = ST.refresh_tree(spark, root, folder, prices)
    assert second.number > first.number and second._read(second.segments[-1], "lines").select("file_path").distinct().count() == 2
    quiet.write_bytes(text)
    os.utime(quiet, ns=(before.st_atime_ns, before.st_mtime_ns))
    same(spark, root, folder, prices)
    # The version before is still whole.
    assert ST.Store(spark, folder, first.number).table("sessions").count() == 3


def test_a_death_before_or_in_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    root, folder, prices = build(tmp_path / "logs"), str(tmp_path / "store"), default_prices(spark)
    first = ST.refresh_tree(spark, root, folder, prices)
    old = rows(first.table("sessions"))
    write_session(tmp_path / "logs", "-p-a", "s1", lines(1, 6, "a"))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", die)
        with pytest.raises(KeyboardInterrupt):
            ST.refresh_tree(spark, root, folder, prices)
    assert ST.Store(spark, folder).number == first.number and rows(ST.Store(spark, folder).table("sessions")) == old
    (tmp_path / "store/versions" / str(first.number + 1)).write_text('{"segments": [')  # cut off while being written
    assert ST.Store(spark, folder).number == first.number
    again = ST.refresh_tree(spark, root, folder, prices)
    assert again.number == first.number + 2
    same(spark, root, folder, prices)
    with pytest.raises(versions.VersionTaken):
        versions.commit(spark, folder, first.number, {})


def test_segments_are_merged_and_removed(spark, tmp_path):
    root, folder, prices = build(tmp_path / "logs"), str(tmp_path / "store"), default_prices(spark)
    ST.refresh_tree(spark, root, folder, prices)
    for n in range(3, 6):
        write_session(tmp_path / "logs", "-p-a", "s1", lines(1, n, "a"))
        write_session(tmp_path / "logs", "-p-d", f"s{n}", lines(1, n, "a"))
        state = ST.merge_segments(ST.refresh_tree(spark, root, folder, prices), most=2)
        assert len(state.segments) <= 2
    same(spark, root, folder, prices)
    ST.vacuum(spark, folder, keep=1)
    assert {p.name for p in (tmp_path / "store/segments").iterdir()} == {s.name for s in state.segments}
    same(spark, root, folder, prices)


def test_other_prices_sum_up_every_session(spark, tmp_path):
    from pyspark.sql import functions as F

    root, folder, prices = build(tmp_path / "logs"), str(tmp_path / "store"), default_prices(spark)
    ST.refresh_tree(spark, root, folder, prices)
    dearer = prices.withColumn("output_price", (F.col("output_price") * 2).cast("decimal(12,8)"))
    ST.refresh_tree(spark, root, folder, dearer)
    same(spark, root, folder, dearer)


def test_stream_of_chunks_equals_the_whole_and_replays_change_nothing(spark, tmp_path):
    prices, folder = default_prices(spark), str(tmp_path / "store")
    a, b = lines(1, 9, "a"), lines(2, 4, "b")
    write_session(tmp_path / "logs", "-p", "s1", a, {"z.jsonl": b})
    write_session(tmp_path / "logs", "-q", "s2", b)
    chunks = tmp_path / "chunks"
    run = lambda state: store_stream(read_chunk_lines(spark, str(chunks)), folder, str(state), prices).awaitTermination(120)
    write_session(chunks / "001", "-p", "s1", a[:10], {"z.jsonl": b[:5]})
    write_session(chunks / "002", "-p", "s1", a[10:13])
    run(tmp_path / "state")
    # The second batch cuts a turn in two.
    write_session(chunks / "003", "-p", "s1", a[13:20], {"z.jsonl": b[5:]})
    write_session(chunks / "004", "-q", "s2", b)
    write_session(chunks / "005", "-p", "s1", a[20:])
    run(tmp_path / "state")
    state, full = ST.Store(spark, folder), dashboard(spark, str(tmp_path / "logs"), prices)
    assert state.batches == {"stream": 1}
    stored = ST.stored_dashboard(spark, folder, prices)
    for name in full:
        assert rows(full[name], ("last_active",)) == rows(stored[name], ("last_active",)), name
    batch = spark.read.text(str(chunks / "005"), recursiveFileLookup=True)
    from pyspark.sql import functions as F

    batch = batch.select("value", F.col("_metadata.file_path").alias("chunk_path"), F.col("_metadata.file_size").alias("chunk_bytes"), F.col("_metadata.file_block_start").alias("offset"))
    assert ST.append_chunks(spark, folder, batch, 1, prices).number == state.number
    run(tmp_path / "lost")  # the checkpoint is lost: batch 0 comes again
    assert ST.Store(spark, folder).number == state.number
