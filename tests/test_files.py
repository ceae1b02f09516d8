from __future__ import annotations

from logloom.operators import files as FI
from logloom.operators import messages as M
from logloom.sources.logs import read_records
from tests.logtree import assistant, tool_result, tool_use, user, write_session


def test_bare_names_join_their_full_path(spark, tmp_path):
    def seen(ident, start, end):
        return user("1", [tool_result(ident, "text")], toolUseResult={"type": "text", "content": {"file": {"numLines": end - start + 1, "totalLines": 200}}, "path": None, "filePath": "helper.ts" if ident == "a" else "src/helper.ts"})

    write_session(tmp_path, "-p", "s", [
        assistant("1", [tool_use("a", "Read", file_path="helper.ts", startLine=10, endLine=20)]), seen("a", 10, 20),
        assistant("2", [tool_use("b", "Read", file_path="src/helper.ts", startLine=80, endLine=90)]), seen("b", 80, 90),
        assistant("3", [tool_use("c", "Read", file_path="other/Helper.md")]),
    ])
    records = read_records(spark, str(tmp_path))
    mentions = FI.file_mentions(M.tool_calls(records), M.message_blocks(records)).cache()
    files = FI.context_files(mentions)
    got = {r["full_path"]: (r["in_context"], r["first_seq"], r["total_count"], r["mentions"]) for r in files.collect()}
    assert got == {"src/helper.ts": (True, 0, 200, 4), "other/Helper.md": (False, 4, None, 1)}
    keys = ["project_id", "session_id", "file_key"]
    cover = FI.file_coverage(FI.merge_ranges(FI.mention_ranges(mentions, files), keys), keys, files.select(*keys, "total_count"))
    row = cover.first()
    assert (row["file_key"], row["loaded_lines"], row["percent"], row["is_partial"]) == ("src/helper.ts", 22, 11, True)
    assert FI.line_token_estimate(cover, ["session_id"]).first()["token_estimate"] == 88


def test_coverage_is_cut_to_the_file_and_falls_back_to_the_loaded_count(spark):
    from logloom.operators import files as FI

    mentions = spark.createDataFrame(
        [("p", "s", "one.py", 1, 10), ("p", "s", "one.py", 4, 30)], "project_id string, session_id string, path string, start long, end long"
    )
    files = spark.createDataFrame(
        [("p", "s", "one.py", "one.py", True, 8, None), ("p", "s", "two.py", "two.py", True, 40, 10), ("p", "s", "no.py", "no.py", True, 5, None)],
        "project_id string, session_id string, file_key string, full_path string, is_home boolean, total_count long, loaded_count long",
    )
    got = {r.file_key: (r.loaded_lines, r.range_count, r.percent, r.is_partial) for r in FI.context_coverage(mentions, files).collect()}
    assert got == {"one.py": (8, 1, 100, False), "two.py": (10, 0, 25, True)}


def test_mention_queries_write_only_what_they_read(spark, monkeypatch):
    from logloom.plans import log_queries as L

    written = []

    def keep(df):
        written.append(df)
        return df

    monkeypatch.setattr(L, "cut_lineage", keep)
    L.file_mentions(spark, "/root/testdata/sf0.001")
    assert written and all(not {"summary", "title", "full_content", "old_text"} & set(df.columns) for df in written)
    assert {r.tool_name for r in written[0].select("tool_name").distinct().collect()} == {"Read"}
    written.clear()
    L._hunks(spark, "/root/testdata/sf0.001")
    assert all(not {"summary", "title"} & set(df.columns) for df in written)
    assert {r.block_type for r in written[1].select("block_type").distinct().collect()} == {"tool-result"}


def test_preferred_details_take_the_first_match_of_key_or_tail(spark):
    from pyspark.sql import functions as F

    from logloom.functions.details import detail_lookup, details_preferred

    rows = [
        (1, [("a.path", "A", "x"), ("path", "P", "y"), ("n", "N", "2")]), (2, [("path", "P", "y"), ("a.path", "A", "x")]),
        (3, [("q", "Q", "z")]), (4, []), (5, None), (6, [("n.", "N", "1"), ("b.file", "F", "f")]),
    ]
    df = spark.createDataFrame(rows, "id int, d array<struct<key:string,label:string,value:string>>")
    wanted = {"one": ["file", "path"], "two": ["n"], "three": ["a.path"]}
    fast = details_preferred(F.col("d"), wanted)
    slow = F.struct(*[F.coalesce(*[detail_lookup(F.col("d"), [c]) for c in names]).alias(n) for n, names in wanted.items()])
    got = df.select("id", fast.alias("f"), slow.alias("s")).orderBy("id").collect()
    assert [tuple(r.f) for r in got] == [tuple(r.s) for r in got]
    assert got[0].f.one == "x" and got[0].f.two == "2" and got[4].f.one is None
