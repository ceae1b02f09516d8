from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import mixing, sharding
from tests.llm.helpers import clashing, documents, prose


def fill(sizes, weights, repeats=3):
    """Targets by sharing again and again."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        over = [i for i in free if share[i] > repeats * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed.update({i: repeats * sizes[i] for i in over})


def rows():
    out = [(i, prose(i, 5 + i % 37), f"s{'abc'[i % 3] if i % 2 else 'a'}") for i in range(1500)]
    out += [(2000 + i, prose(i, 8), "tiny") for i in range(12)] + [(3000 + i, prose(i, 20), None) for i in range(30)]
    return out + [(4000, None, "empty"), (4001, " \n", "empty"), (5, prose(5, 11), "sa"), (5, prose(5, 11), "sa"), (None, "a b c", "sb")]


def test_mix(spark):
    data = rows()
    got = mixing.mix(clashing(documents(spark, data).repartition(4))).collect()
    again = mixing.mix(documents(spark, data)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.shards)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(data)
    sizes = Counter()
    for _, text, source in data:
        sizes[source] += len((text or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    wanted = dict(zip(order, fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    source_of = {(str(k), len((t or "").split())): s for k, t, s in data}
    taken, per_shard = Counter(), Counter()
    for r in got:
        source = source_of[str(r.doc_id), r.size]
        assert r.source_size == sizes[source] and r.target == pytest.approx(wanted[source]) and len(r.shards) <= 3
        taken[source] += r.size * len(r.shards)
        per_shard.update({s: r.size for s in r.shards})
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= max(3, 0.01 * target), source
    assert set(per_shard) <= set(range(8))


def test_mixed_documents(spark):
    df = documents(spark, rows())
    plan = Counter()
    for r in mixing.mix(df).collect():
        plan[str(r.doc_id), r.size] += len(r.shards)
    got = Counter((str(r.doc_id), len((r.text or "").split())) for r in mixing.mixed_documents(df).collect())
    assert got == +plan


def test_split_tree():
    quotas = [1000, 17, 3, 0, 260]
    split = mixing.split_tree(quotas, 8)
    assert split.sum(axis=1).tolist() == quotas and (split >= 0).all()
    assert max(split.sum(axis=0)) - min(split.sum(axis=0)) <= 3
    assert (mixing.split_tree(quotas, 8) == split).all()


def test_shards_are_disjoint_and_even(spark):
    got = sharding.shard_records(clashing(documents(spark, rows()))).collect()
    want = sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert max(load.values()) - min(load.values()) <= 40
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_one_key_on_many_records(spark):
    rows = [(7, "one row that stands often")] * 900 + [(7, f"text {k}") for k in range(900)] + [(None, f"none {k}") for k in range(900)] + [(k, "x" * 10) for k in range(100, 1000)]
    df = documents(spark, rows)
    got = sharding.shard_records(df.repartition(5)).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert len(got) == len(rows) and max(load.values()) - min(load.values()) <= 100
    slot = lambda found: sorted((str(r.doc_id), r.text_crc32, r.virtual_slot) for r in found)
    assert slot(got) == slot(sharding.shard_records(df.coalesce(1)).collect())


def test_edits_move_few_slots(spark):
    rng = np.random.default_rng(1)
    loads = {s: int(v) for s, v in enumerate(rng.integers(50, 150, 4096))}
    first = [s % 8 for s in range(4096)]
    second = sharding.edit_map(first, loads, 8)
    assert sum(a != b for a, b in zip(first, second)) < 200
    total = np.bincount(second, [loads[s] for s in range(4096)])
    assert total.max() - total.min() <= 50
    slot_map = sharding.SlotMap(spark, sharding.Scratch(spark, "t").path)
    slot_map.store(first)
    slot_map.store(second)
    assert slot_map.table(1).filter(F.col("virtual_slot") == 9).first().shard == 1 and slot_map.table().count() == 4096
    assert sharding.edit_map([0, 1], {0: 5}, 2) == [0, 1]


def test_a_later_run_opens_and_edits_the_map(spark, tmp_path):
    path = str(tmp_path / "map")
    with pytest.raises(ValueError):
        sharding.SlotMap.open(spark, path)
    first = sharding.SlotMap(spark, path, 64)
    first.store([s % 4 for s in range(64)])
    first.store([(s + 1) % 4 for s in range(64)])
    (tmp_path / "map/version=3").mkdir()  # a write that never ended
    later = sharding.SlotMap.open(spark, path)
    assert (later.version, later.slots) == (2, 64) and later.table().filter("virtual_slot = 5").first().shard == 2
    records = spark.createDataFrame([(s % 64, 10 + s % 7) for s in range(640)], "virtual_slot int, size long")
    sharding.rebalance(records, later, 4)
    again = sharding.SlotMap.open(spark, path)
    before, after = ({r.virtual_slot: r.shard for r in again.table(v).collect()} for v in (2, 4))
    assert again.version == 4 and sum(before[s] != after[s] for s in range(64)) < 16


def test_empty(spark):
    assert sharding.shard_records(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [])).count() == 0


def test_one_row_under_two_sources(spark):
    text = prose(1, 20)
    df = documents(spark, [(1, text, "a")] * 600 + [(1, text, "b")] * 600 + [(k, prose(k, 20), "b") for k in range(10, 400)] + [(None, None, "c")] * 50)
    target, words = {}, Counter()
    for r in mixing.mix(df).collect():
        target[r.source] = r.target
    for r in mixing.mixed_documents(df.repartition(3)).collect():
        words[r.source] += len((r.text or "").split())
    assert all(abs(words[s] - t) <= max(20, 0.01 * t) for s, t in target.items())


def test_frequent_rows_fill_no_block(spark):
    df = documents(spark, [(7, "one row that stands often", "a")] * 4000 + [(k, prose(k, 5), "a") for k in range(100, 2100)])
    got = mixing.mix(df.repartition(6)).collect()
    blocks = Counter(r.place % 12 for r in got if r.doc_id == 7)
    assert len(blocks) == 12 and max(blocks.values()) < 500
    again = mixing.mix(df.coalesce(1)).collect()
    key = lambda r: (r.doc_id, r.place, r.shards)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_number_copies(spark):
    from logloom.llm.common import number_copies

    rows = [(k % 3 if k % 3 else None, k % 5) for k in range(400)]
    df = spark.createDataFrame(rows, "k bigint, part int")
    seen = defaultdict(list)
    for r in number_copies(df, ["k"]).collect():
        seen[r.k].append(r.nth)
    assert all(sorted(v) == list(range(sum(k == key for k, _ in rows))) for key, v in seen.items()) and len(seen) == 3
