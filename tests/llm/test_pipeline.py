from __future__ import annotations

import re

import corpus_pipeline
from logloom.llm.common import table
from tests.llm import test_minhash, test_quality, test_suffix_dedup
from tests.llm.helpers import documents, prose

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    steps = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step = corpus_pipeline.Scratch(spark, "test").save(stage(spark, steps[-1], FOLDER), f"s{n}")
        assert n == 4 or step.columns == columns
        steps.append(step)
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:4]]
    for r in rows[0].values():  # stage 1: base rules hold, nothing is changed
        assert r.doc_id not in rows[1] or (not test_quality.counts(r.text)[5] and rows[1][r.doc_id] == r)
    good = {r.doc_id for r in table(spark, FOLDER, "labels").filter("quality = 1").collect()}
    fair = [k for k in good if k in rows[0] and not test_quality.counts(rows[0][k].text)[5]]
    assert sum(k in rows[1] for k in fair) >= 0.95 * len(fair)
    kept = {k for k, _, _, keep in test_minhash.brute([(r.doc_id, r.text) for r in rows[1].values()]) if keep}
    assert set(rows[2]) == kept
    want = {k: n for k, _, n, _, _ in test_suffix_dedup.brute([(r.doc_id, r.text) for r in rows[2].values()])}
    assert set(rows[3]) == {k for k, n in want.items() if n < len(rows[2][k].text.encode())}
    assert all(rows[3][k].text == rows[2][k].text for k in rows[3] if want[k] == 0)
    mixed = steps[4].collect()
    assert {r.doc_id for r in mixed} <= set(rows[3]) and all(r == rows[3][r.doc_id] for r in mixed)
    size = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rs)
    assert abs(size(mixed) / size(rows[3].values()) - 1) < 0.02
    pieces = steps[5].collect()
    assert sorted(r.doc_id for r in pieces if r.piece == 0) == sorted(r.doc_id for r in mixed)
    fill = {}
    for r in pieces:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


def test_odd_rows(spark):
    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (2, None), (None, prose(2, 40)), (3, ""), (4, prose(1, 50) + " " + prose(3, 60))]
    docs, empty = documents(spark, rows), documents(spark, [])
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs, FOLDER).count() > 0
        assert stage(spark, empty, FOLDER).count() == 0


def test_repeated_and_missing_ids(spark):
    a, b, c, d = (prose(n, 60) for n in (11, 12, 13, 14))
    rows = [(1, a)] * 5 + [(None, a + " tail"), (None, b), (None, b + " tail"), (None, b), (None, c), (9, c), (3, d), (3, d + " tail"), (3, prose(15, 60))]
    rows += [(5, None), (5, None), (None, "")]
    got = corpus_pipeline.near_dedup(spark, documents(spark, rows).repartition(3), FOLDER)
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert [x for x in found if x[1] in (a, a + " tail")] == [(1, a)]
    assert sum(t in (b, b + " tail") for _, t in found) == 1
    assert sum(t in (d, d + " tail") for _, t in found) == 1 and (3, prose(15, 60)) in found
    assert [x for x in found if x[1] == c] == [(9, c)] and len([x for x in found if not x[1]]) == 3


def test_clashing_names_and_maps_pass_every_stage(spark):
    from pyspark.sql import functions as F

    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (2, None), (None, prose(2, 40)), (None, prose(2, 40)), (3, ""), (4, prose(1, 50) + " " + prose(3, 60)), (5, prose(6, 80))]
    names = ["key", "copies", "digest", "told_id", "row", "id", "of", "mixer", "place", "shard", "_shard", "_id", "part", "nth", "in_text", "chunk", "piece", "size"]
    docs = documents(spark, rows).withColumns({n: F.concat(F.lit(n), F.coalesce("doc_id", F.lit(0))) for n in names} | {"tags": F.create_map(F.lit("a"), F.col("doc_id"))})
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, FOLDER)
        assert n == 4 or got.columns == docs.columns
        found = got.collect()
        assert found
        if n < 4:
            assert all(r.tags == {"a": r.doc_id} and r.told_id == f"told_id{r.doc_id or 0}" for r in found)
    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 2, 3, 4, 5, None]
