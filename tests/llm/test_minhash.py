from __future__ import annotations

import random
import re

import numpy as np
import pytest

from logloom.llm import minhash
from logloom.llm.common import Scratch
from logloom.llm.components import components
from logloom.llm.minhash import near_duplicates
from tests.llm.helpers import clashing, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    last = (1 << 63) - 1
    rows = [(last if k is None else k, shingles(t)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            n = len(x & y)
            if n and 100 * n >= 85 * (len(x) + len(y) - n):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    out = []
    for k, s in rows:
        c = find(k) if s else k
        out.append((None if k == last else k, len(s), None if c == last else c, k == c))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(5)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (3, "One  TWO"), (1004, "É two"), (1005, "é two"), (1006, "a b c d e f g h i"),
            (1007, "a b c d e f g h i j"), (None, "one two"), (1008, "a b c d e f g h i k")]
    base = prose(1, 200).split()
    for i in range(60):  # near copies of one text; the text itself comes late
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(200)] = f"e{rng.randrange(50)}"
        rows.append((100 + i, " ".join(words)))
    rows.append((500, " ".join(base)))
    chain = prose(2, 150).split()
    for i in range(30):  # a chain: neighbours are alike, ends are not
        chain[(i * 5) % 150] = f"c{i}"
        rows.append((600 + i, " ".join(chain)))
    for i in range(40):  # a shared passage only
        rows.append((700 + i, prose(3, 60) + " " + prose(50 + i, rng.randrange(5, 60))))
    rows += [(800 + i, prose(9, 40)) for i in range(20)]
    rows += [(900 + i, prose(400 + i, 30)) for i in range(20)]
    return rows


def test_equals_brute_force(spark):
    rows = cases()
    got = near_duplicates(clashing(documents(spark, rows)).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", -1)
    rows = cases()
    assert sorted(map(tuple, near_duplicates(documents(spark, rows)).collect()), key=repr) == brute(rows)


def test_empty(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    got = near_duplicates(documents(spark, [(1, "x y"), (1, "x y"), (2, None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("similarity", [0.5, 0.85])
def test_signatures_estimate_similarity(similarity):
    rng = np.random.default_rng(1)
    errors = []
    for n in (30, 400):
        common = int(n * similarity)
        values = rng.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
        sets = [np.sort(values[:n]), np.sort(values[n - common:])]
        doc = np.repeat([0, 1], [len(s) for s in sets])
        bins = minhash.signatures(doc, np.concatenate(sets), 2)
        errors.append((bins[0] == bins[1]).mean() - common / (2 * n - common))
    assert max(map(abs, errors)) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, i) for i in range(10, 60)] + [(59, 3), (200, 200)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, Scratch(spark, "t"), "c").collect()}
    assert got == {i: 100 for i in range(100, 131)} | {i: 3 for i in [3, 5, *range(10, 60)]}
    assert components(df.limit(0), Scratch(spark, "t"), "c").count() == 0


def test_template_pages_cost_little_and_lose_no_link(spark, monkeypatch):
    """Pages of one template, 60 to 75 % alike, with a few linked pairs among them, all in one bucket."""
    frame = prose(77, 140, 5000)
    rows = [(i, frame + " " + prose(1000 + i, 45, 100_000)) for i in range(1200)]
    for i in range(0, 1200, 60):  # the same page but for its last words
        rows.append((5000 + i, rows[i][1] + " " + prose(9000 + i, 8)))
    monkeypatch.setattr(minhash, "BLOCK", 200)
    sets = {k: np.sort(np.array([hash(x) for x in shingles(t)]).astype(np.int64).view(np.uint64)) for k, t in rows}
    compared = []

    class Part(minhash._Members):
        def __init__(self, keys, own):
            self.ids, self.sets = np.array(keys), [sets[k] for k in keys]
            self.of, self.main, self.sizes = self.ids, np.full(len(keys), -1), np.array([len(x) for x in self.sets])
            self.bins = np.zeros((len(keys), minhash.BINS), np.uint32)
            self.values, self.member = np.concatenate(self.sets), np.repeat(np.arange(len(keys)), self.sizes)

    class Block(Part, minhash._Standing):
        def __init__(self, keys):
            Part.__init__(self, keys, True)
            self.known, inverse, self.counts = np.unique(self.values, return_inverse=True, return_counts=True)
            kept = self.rarest(self.counts[inverse])
            kept = kept[np.argsort(self.values[kept], kind="stable")]
            self.head, self.holder = self.values[kept], self.member[kept]

    keys = [k for k, _ in rows]
    stand, seek = Block(keys), Part(keys, False)
    compared = [(keys[i], keys[k]) for i, k in stand.candidates(seek) if keys[i] < keys[k]]
    want = {(i, 5000 + i) for i in range(0, 1200, 60)}
    assert want <= set(compared) and len(compared) < 5 * len(keys)
    got = sorted(map(tuple, near_duplicates(documents(spark, rows)).collect()), key=repr)
    links = {r[0]: r[2] for r in got}
    assert all(links[5000 + i] == i for i in range(0, 1200, 60)) and sum(r[3] for r in got) == 1200
