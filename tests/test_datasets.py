from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logloom.sources import datasets as D
from logloom.sources import versions
from tests.logtree import user, write_session


def content(spark, folder, number=None):
    return sorted((r["file_path"], r["value"]) for r in D.read_dataset(spark, folder, number).collect())


@pytest.fixture
def exports(spark, tmp_path):
    """Two exports: one session, then two more lines and a project named like a number."""
    out = []
    for n in (1, 2):
        write_session(tmp_path / f"logs{n}", "-p", "s1", [user("2026-01-01T10:00:00Z", f"q {i}") for i in range(2 * n)], {"x.jsonl": [user("2026-01-01T10:00:00Z", "sub")]})
        if n == 2:
            write_session(tmp_path / "logs2", "007", "s2", [user("2026-01-01T10:00:00Z", "z")])
        D.export_dataset(spark, str(tmp_path / f"logs{n}"), str(tmp_path / f"out{n}"), "here")
        out.append(str(tmp_path / f"out{n}"))
    return out


def test_an_import_replaces_the_whole_and_keeps_versions(spark, tmp_path, exports):
    target = str(tmp_path / "in")
    assert D.import_dataset(spark, exports[0], target).first()["file_count"] == 2
    old = content(spark, target)
    made = D.import_dataset(spark, exports[1], target).first()
    assert (made["project_count"], made["session_count"], made["file_count"]) == (2, 2, 3)
    assert len(content(spark, target)) == 6 and content(spark, target, 1) == old
    assert {p.split("/")[1] for p, _ in content(spark, target)} == {"-p", "007"}
    D.forget_imports(spark, target)
    assert len(content(spark, target)) == 6 and len(list((tmp_path / "in/data").iterdir())) == 1


def test_a_damaged_or_broken_import_leaves_the_old_data(spark, tmp_path, exports, monkeypatch):
    target = str(tmp_path / "in")
    D.import_dataset(spark, exports[0], target)
    old = content(spark, target)
    # A line is lost, then one is changed, under the same checksums.
    whole = spark.read.parquet(f"{exports[1]}/lines")
    for n, bad in enumerate((whole.filter("value not like '%q 3%'"), whole.withColumn("value", F.replace("value", F.lit("q 3"), F.lit("q 4"))))):
        folder = str(tmp_path / f"bad{n}")
        for name in ("files", "manifest"):
            (tmp_path / f"bad{n}").mkdir(exist_ok=True)
            (tmp_path / f"bad{n}" / name).symlink_to(f"{exports[1]}/{name}")
        bad.write.partitionBy("project_id").parquet(f"{folder}/lines")
        with pytest.raises(D.DamagedDataset):
            D.import_dataset(spark, folder, target)
        assert content(spark, target) == old
    # The writer dies between staging and the commit.
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            D.import_dataset(spark, exports[1], target)
    assert content(spark, target) == old
    D.import_dataset(spark, exports[1], target)
    assert len(content(spark, target)) == 6


def test_no_dataset(spark, tmp_path, exports):
    with pytest.raises(ValueError):
        D.read_dataset(spark, str(tmp_path / "none"))
