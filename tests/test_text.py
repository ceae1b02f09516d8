from __future__ import annotations

from logloom.functions import details as D
from logloom.functions import text as X
from pyspark.sql import functions as F


def run(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("out")).collect()]


def test_paths(spark):
    mixed = ["E:\\Work\\\\loom//weft\\warp.py", "/srv//data///x.csv", "plain"]
    assert run(spark, X.normalise_path, *mixed) == ["E:/Work/loom/weft/warp.py", "/srv/data/x.csv", "plain"]
    relative = lambda c: X.relative_path(c, F.lit("e:/work/LOOM/"))
    assert run(spark, relative, "E:\\Work\\Loom\\weft\\warp.py\n/etc/hosts\ne:/work/loom/setup.cfg", "E:/Work/Loom") == ["weft/warp.py\n/etc/hosts\nsetup.cfg", "."]
    parts = run(spark, X.split_path, "docs/guide/intro.md", "Q:/" + "/".join(f"level{n}" for n in range(12)) + "/end.txt", "README")
    assert [tuple(p) for p in parts] == [("docs/guide/", "intro.md"), ("Q:.../", "end.txt"), ("", "README")]
    assert run(spark, X.diff_key, "./Weft\\Warp.PY") == ["weft/warp.py"]
    assert run(spark, X.project_name, "-srv-data-loom", "y-") == ["loom", "y-"]


def test_newlines_and_numbers(spark):
    # Written line breaks count where a text has no real one.
    assert run(spark, X.unescape_newlines, "warp\\r\\nweft\\nweave", "warp\nweft\\nweave", "") == ["warp\nweft\nweave", "warp\nweft\\nweave", ""]
    assert run(spark, X.parse_line_number, "90,817", "Line 6 of 8", "L305-L310", "none given", None) == [90817, 6, 305, None, None]
    assert run(spark, X.parse_line_count, " 20,480 ", "L9", "11") == [20480, None, 11]
    assert run(spark, X.parse_exit_code, "-9", "Exit code: 127", "exit 0", "done", None) == [-9, 127, 0, None, None]


def test_detail_keys(spark):
    df = spark.createDataFrame([([("source.item.shardName", "Shard", "a"), ("place", "Place", "b")],)], f"d array<{D.DETAIL}>")
    row = df.select(
        D.detail_lookup(F.col("d"), ["shardName"]), D.detail_lookup(F.col("d"), ["source.item.shardName"]), D.detail_lookup(F.col("d"), ["item"]),
        D.detail_preferred(F.col("d"), ["place", "shardName"]),
    ).first()
    assert tuple(row) == ("a", "a", None, "b")


def test_languages_and_labels(spark):
    names = ["a/B.TSX", "x.d.cts", "ops/Dockerfile", ".gitignore", "a.", "q.py?x=1#y", "noext", "b.tar.yml"]
    assert run(spark, X.code_language, *names) == ["typescript", "typescript", "bash", None, None, "python", None, "yaml"]
    assert run(spark, D.humanise, "content.file_path", "durationMs") == ["Content file path", "Duration Ms"]
    assert run(spark, D.truncate_inline, " a \n b ", "x" * 200) == ["a b", "x" * 157 + "..."]
