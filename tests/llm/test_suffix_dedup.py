from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from logloom.llm import suffix_dedup
from logloom.llm.suffix_dedup import merge_sorted, remove_repeats
from tests.llm.helpers import clashing, documents, prose


def brute(rows, n=50):
    rows = [((1 << 63) - 1 if k is None else k, k, (t or "").encode()) for k, t in rows]
    least = {}
    for rank, _, raw in rows:
        for p in range(len(raw) - n + 1):
            w = raw[p:p + n]
            least[w] = min(rank, least.get(w, rank))
    out = []
    for rank, key, raw in rows:
        gone = [False] * len(raw)
        for p in range(len(raw) - n + 1):
            if least[raw[p:p + n]] < rank:
                gone[p:p + n] = [True] * n
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    base, passage = prose(1, 300), prose(2, 30)
    rows = [(10, base), (3, base), (11, base + " tail"), (12, "x" * 400), (13, "y" + "x" * 120), (14, None), (15, ""), (16, "x" * 49)]
    rows += [(None, base), (3, prose(5, 40) + passage), (7, "\0" * 90), (8, "a" + "\0" * 60), (9, "ab" * 70), (6, "äöü" * 40), (5, "zäöü" * 2 + "äöü" * 30)]
    for i in range(40):
        words = base.split() if i % 3 else passage.split() + prose(i, 50).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"e{i}"
        rows.append((rng.randrange(20, 90), prose(100 + i, rng.randrange(30)) + " " + " ".join(words)))
    return rows


@pytest.mark.parametrize("chunk_bytes", [300, 5000, 1 << 22])
def test_equals_brute_force(spark, chunk_bytes):
    rows = cases()
    got = remove_repeats(clashing(documents(spark, rows)), chunk_bytes=chunk_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_small_buckets_and_shuffled_answers(spark, monkeypatch):
    from logloom.llm import chunks

    monkeypatch.setattr(chunks, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(chunks, "BROADCAST_BYTES", -1)
    rows = cases()
    got = remove_repeats(documents(spark, rows).repartition(5), chunk_bytes=2000).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


@pytest.mark.parametrize("hot", [1, 6])
def test_many_hops_and_hot_grams(spark, monkeypatch, hot):
    """A header in every third text with other words around it, spread by string hashes, through several hops."""
    from logloom.llm import chunks

    monkeypatch.setattr(chunks, "BUCKET_BYTES", 2500)
    monkeypatch.setattr(chunks, "FAN", 3)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    header = "all rights reserved by the people who wrote it"
    rows = cases() + [(200 + i, f"{prose(300 + i, 4)} {header if i % 3 else header[:24]} {prose(400 + i % 7, 6)}") for i in range(40)]
    got = remove_repeats(documents(spark, rows).repartition(4), chunk_bytes=1500).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_extreme_ids(spark):
    rows = [((1 << 63) - 1, prose(1, 40)), (-(1 << 63), prose(1, 20)), (None, prose(2, 9)), (0, prose(2, 9) + " x")]
    got = remove_repeats(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_rows_of_an_exchange_grow_with_the_chunks():
    from logloom.llm.chunks import FAN, Routes

    for chunks, buckets in ((50, 12), (5_000, 1_300), (26_000_000, 6_500_000)):
        routes = Routes(buckets, chunks)
        assert routes.fan <= FAN and routes.fan ** routes.hops >= buckets
        # Every hop: groups of a level times the addresses of each.
        for level in range(routes.hops):
            groups = routes.fan ** level * max(1, -(-chunks // routes.fan ** level))
            assert groups * routes.fan <= 2 * FAN * chunks
        assert [routes.toward(buckets - 1, routes.hops), routes.panel(7, 0)] == [buckets - 1, 7]
        assert all(routes.panel(c, level) == routes.panel(c, 1) // routes.fan ** (level - 1) for c in (0, 9 << 32) for level in range(1, routes.hops))


def test_empty_and_texts(spark):
    assert remove_repeats(documents(spark, [])).count() == 0
    base = prose(1, 60)
    rows = remove_repeats(documents(spark, [(1, base), (2, "new " + base)]), texts=True, carry=["source"]).collect()
    assert {r.in_source for r in rows} == {"s"}
    assert {r.doc_id: r.text for r in rows} == {1: base, 2: "new "}


def test_merge_and_front_coding():
    rng = np.random.default_rng(1)
    runs = [np.sort(rng.integers(0, 3, (n, 4)).astype(np.uint8).view(">u4").ravel()) for n in (50, 0, 7, 120, 1)]
    keys = [r.astype(">u4").view(np.uint8).reshape(-1, 4) for r in runs]
    for k in keys:
        if len(k):
            shared, rest = suffix_dedup.front_code(k)
            assert (suffix_dedup.front_decode(shared.astype(np.int64), np.frombuffer(rest, np.uint8), 4) == k).all()
    shared = [suffix_dedup.front_code(k)[0].tolist() if len(k) else [] for k in keys]
    order, prefix = merge_sorted([r.tolist() for r in runs], shared, 4)
    place, merged = [0] * 5, []
    for run in order:
        merged.append(int(runs[run][place[run]]))
        place[run] += 1
    assert merged == sorted(merged) and len(merged) == 178
    raw = [m.to_bytes(4, "big") for m in merged]
    want = [0] + [next((i for i in range(4) if a[i] != b[i]), 4) for a, b in zip(raw, raw[1:])]
    assert prefix == want
