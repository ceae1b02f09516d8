from __future__ import annotations

import hashlib
import re

import pytest

from logloom.llm.substring_dedup import remove_windows
from tests.llm.helpers import clashing, documents, prose
from tests.llm.test_suffix_dedup import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=20):
    docs = sorted((((1 << 63) - 1 if k is None else k), k, WORD.findall(t or "")) for k, t in rows)
    first = {}
    for at, (rank, _, words) in enumerate(docs):
        for p in range(len(words) - n + 1):
            w = tuple(words[p:p + n])
            first[w] = min(first.get(w, (rank, p, at)), (rank, p, at))
    out = []
    for at, (rank, key, words) in enumerate(docs):
        gone = [False] * len(words)
        for p in range(len(words) - n + 1):
            if first[tuple(words[p:p + n])] != (rank, p, at):
                gone[p:p + n] = [True] * n
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((key, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def distinct(rows):
    """Rows with one doc_id have no order that a brute force could know; give each its own id."""
    seen, out = set(), []
    for key, text in rows:
        while key in seen:
            key += 1000
        seen.add(key)
        out.append((key, text))
    return out


@pytest.mark.parametrize("chunk_bytes", [300, 4000, 1 << 22])
def test_equals_brute_force(spark, chunk_bytes):
    rows = distinct(cases()) + [(5000, "same word " * 60), (5001, "a b\x1fc\x0bd " * 25), (5002, " ".join(["w"] * 20)), (5003, "w\tw\n" * 10)]
    got = remove_windows(clashing(documents(spark, rows)), chunk_bytes=chunk_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_repeated_rows_keep_one(spark):
    text = prose(4, 60)
    got = remove_windows(documents(spark, [(1, text)] * 5 + [(None, text)]), chunk_bytes=400).collect()
    assert sorted(r.n_removed for r in got) == [0, 60, 60, 60, 60, 60]
    assert [r.n_removed for r in got if r.doc_id is None] == [60]


def test_shuffled_answers_and_many_buckets(spark, monkeypatch):
    from logloom.llm import chunks

    monkeypatch.setattr(chunks, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(chunks, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(chunks, "FAN", 3)
    rows = distinct(cases())
    got = remove_windows(documents(spark, rows).repartition(4), chunk_bytes=3000).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_extreme_ids(spark):
    rows = [((1 << 63) - 1, prose(1, 40)), (-(1 << 63), prose(1, 25)), (4, prose(1, 30))]
    got = remove_windows(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty(spark):
    assert remove_windows(documents(spark, [])).count() == 0
    assert [tuple(r)[:3] for r in remove_windows(documents(spark, [(1, None)])).collect()] == [(1, 0, 0)]
