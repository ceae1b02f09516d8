from __future__ import annotations

import random

from logloom.operators import search as X
from logloom.operators.sessions import search_sessions


def test_index_gives_the_rows_of_the_scan_and_skips_parts(spark, tmp_path):
    rng = random.Random(2)
    word = lambda s: "".join(rng.choice("aeioulnrst") for _ in range(6)) + f"{s:03d}"
    rows = [("p", f"s{s:03d}", " ".join(word(s) for _ in range(60))) for s in range(120) for _ in range(4)]
    rows += [("p", "s005", "Grüße AN ALLE"), ("q", "s900", None), ("q", "s901", ""), ("q", "s902", "ab")]
    texts = spark.createDataFrame(rows, "project_id string, session_id string, text string").repartition(5)
    sessions = spark.createDataFrame([(p, s, "2026") for p, s in sorted({r[:2] for r in rows})], "project_id string, session_id string, started_at string")
    folder = str(tmp_path / "index")
    X.build_text_index(texts, folder, part_bytes=16_000)
    inside = rows[40][2][10:31]
    for words in (inside, inside.upper(), "grüSSe", "grüße an", "an alle", "ab", "a", "nowhere to be found", "%", " "):
        want = sorted(r["session_id"] for r in search_sessions(texts, sessions, words, None).collect())
        assert sorted(r["session_id"] for r in X.search_index(spark, folder, sessions, words, None).collect()) == want, words
    report = X.search_report(spark, folder, inside).first()
    assert report["parts"] >= 10 and report["skipped"] >= report["parts"] - 2
    assert X.search_report(spark, folder, "ab").first()["skipped"] == 0
    plan = X.search_index(spark, folder, sessions, inside)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan  # skipped parts are not opened


def test_empty_table(spark, tmp_path):
    texts = spark.createDataFrame([], "project_id string, session_id string, text string")
    sessions = spark.createDataFrame([("p", "s", "2026")], "project_id string, session_id string, started_at string")
    X.build_text_index(texts, str(tmp_path / "i"))
    assert X.search_index(spark, str(tmp_path / "i"), sessions, "abc").count() == 0
    assert X.search_index(spark, str(tmp_path / "i"), sessions, " ").count() == 1
    assert X.search_report(spark, str(tmp_path / "i"), "abc").first()["parts"] == 0
