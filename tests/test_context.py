from __future__ import annotations

import re

from pyspark.sql import functions as F

from logloom.operators import context as C
from logloom.operators import files as FI
from logloom.sources import tables
from logloom.sources.logs import read_records
from tests.logtree import assistant, user, write_session


def test_compatibility_forms_count_like_plain_text():
    wide = "\uff28\uff45\uff4c\uff4c\uff4f"  # full-width Hello
    assert C.normalised_estimate([wide, "Hello", "\ufb01ne", "fine", " ", "\u2460 a"]) == [1, 1, 1, 1, 0, 2]


def test_counter_sees_every_text_once(spark, tmp_path):
    at = "2026-01-01T10:00:00Z"
    text = [{"type": "text", "text": "x" * 40}]
    write_session(tmp_path, "-p", "s1", [user(at, "same words"), user(at, "same words"), user(at, "\ufb01ve \uff21"), assistant(at, text, "m"), user(at, "")])
    records = read_records(spark, str(tmp_path))
    rows = {r["seq"]: r for r in C.counted_contributions(records).collect()}
    by_place = [rows[k]["conversation"] for k in sorted(rows)]
    assert by_place == [2, 2, 2, 7, 0]
    plain = [r["conversation"] for r in sorted(C.prompt_contributions(records).collect(), key=lambda r: r["seq"])]
    assert plain == [2, 2, 3, 7, 0]  # a ligature and a wide letter are no word characters as they stand
    lengths = [r["conversation"] for r in sorted(C.counted_contributions(records, lambda ts: [len(t) for t in ts]).collect(), key=lambda r: r["seq"])]
    assert lengths == [10, 10, 5, 40, 0]
    once = C.count_texts(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "text string"), lambda ts: [1] * len(ts))
    assert once.count() == 2


def test_places_of_a_file_join_bare_names(spark):
    mentions = spark.createDataFrame(
        [("p", "s", seq, 0, 0, path, True, False, None, None, None, None) for seq, path in ((5, "src/A.py"), (2, "a.py"), (2, "a.py"), (9, "SRC/a.py"), (4, "b.py"))],
        "project_id string, session_id string, seq long, kind_order int, pos int, path string, in_context boolean, attached boolean, loaded_count long, total_count long, start long, end long",
    )
    rows = FI.mention_places(mentions, FI.context_files(mentions)).collect()
    assert sorted((r["file_key"], r["seq"], r["place"]) for r in rows) == [("b.py", 4, 1), ("src/a.py", 2, 1), ("src/a.py", 5, 2), ("src/a.py", 9, 3)]


def _few_events(spark, folder):
    rows = spark.range(400).selectExpr(
        "id event_id", "timestamp'2024-01-15 10:00:00' ts", "id % 7 user_id", "element_at(array('click', 'view', 'purchase', 'signup', 'error'), cast(id % 5 + 1 as int)) event_type",
        "id / 2D value", "to_json(named_struct('k', id % 13)) props",
    )
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_lines_of_one_row_group_are_made_by_many_tasks(spark, tmp_path):
    lines = tables.log_lines(spark, _few_events(spark, tmp_path))
    assert lines.count() == 400
    assert lines.select(F.spark_partition_id().alias("p"), "value").groupBy("p").agg(F.count("value")).count() > 4


def test_line_code_is_small_enough_to_be_compiled(spark, tmp_path, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        tables.log_lines(spark, _few_events(spark, tmp_path)).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM only interprets larger methods


def test_contributions_cut_the_content_out_few_times(spark, tmp_path, capsys):
    at = "2026-01-01T10:00:00Z"
    odd = [
        7, None, "x", {"type": "text", "text": None}, {"type": "text", "content": "a b"}, {"type": 3}, {"type": "text", "text": {"b": 1}},
        {"type": "tool_result", "content": ["y"]}, {"type": "thinking", "thinking": " ", "signature": "s"}, {"type": "tool_use", "name": "n", "input": {"q": 1}}, [1],
    ]
    bodies = [odd, [], None, 5, True, {"type": "text"}, "said <command-name>", " plain "]
    lines = [user(at, b) for b in bodies] + [user(at, odd) | {"toolUseResult": {"a": 1}}] + [assistant(at, b, "m") for b in bodies]
    write_session(tmp_path, "-p", "s1", lines)
    given = C.prompt_contributions(read_records(spark, str(tmp_path)))
    rows = [[r[b] for b in (*C.BUCKETS, "hidden_thinking")] for r in given.orderBy("seq").collect()]
    said = [[7, 0, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 7, 0, 0]]
    none = [0] * 7
    assert rows == [[0, 24, 0, 0, 10, 27, 0], *[none] * 5, *said, [0, 7, 0, 0, 21, 22, 1], *[none] * 5, [0, 7, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0]]
    given.explain("simple")
    assert capsys.readouterr().out.count("$.content") < 20
