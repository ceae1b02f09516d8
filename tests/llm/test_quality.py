from __future__ import annotations

import re
from collections import Counter
from itertools import product

import numpy as np

from logloom.llm import quality
from logloom.llm.common import table
from tests.llm.helpers import clashing, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id bigint, quality int, toxic int"
ROWS = [(1, None), (2, ""), (3, "few words"), (4, prose(1, 100)), (5, (prose(2, 12) + "\n") * 9), (6, "a|b ÄÖ #1\n\n \nx$ <y>\nx$ <y>\r\nx$ <y>"),
        (7, prose(3, 30) + " " + prose(4, 9) + " mid " + prose(4, 9)), (8, "  x\x1f é " * 30), (8, "  x\x1f é " * 30), (None, prose(5, 25)), (9, prose(6, 20_000))]


def counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), failed


def test_counts(spark):
    labels = spark.createDataFrame([], LABELS)
    got = quality.judge(clashing(documents(spark, ROWS)).repartition(2), labels).collect()
    want = sorted(((k, *counts(t)) for k, t in ROWS), key=repr)
    assert sorted((tuple(r)[:7] for r in got), key=repr) == want
    assert all(r.kept is not r.base_failed for r in got)
    assert quality.judge(documents(spark, []), labels).count() == 0


def test_viterbi_equals_search():
    rng = np.random.default_rng(2)
    field = quality.LineField(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    n_lines = np.array([1, 6, 3])
    x = rng.random((10, quality.N_FEATURES)) < 0.3
    got, at = field.decode(x, n_lines), 0
    for n in n_lines:
        score = x[at:at + n] @ field.weights
        best = max(product((0, 1), repeat=int(n)), key=lambda y: sum(score[i, k] for i, k in enumerate(y)) + sum(field.steps[a, b] for a, b in zip(y, y[1:])))
        assert got[at:at + n].tolist() == [bool(k) for k in best]
        at += n


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    sampled = quality.fit_field(docs, labels, sample_docs=150)
    train = {r.doc_id for q in (0, 1) for r in labels.filter(f"quality = {q}").orderBy(quality.F.xxhash64("doc_id"), "doc_id").limit(150).collect()}
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    b = quality.Batch([r.text for r in rows])
    content = sampled.decode(b.features, b.n_lines)
    ends = np.concatenate([[0], np.cumsum(b.n_lines)])
    kept = np.diff(np.concatenate([[0], np.cumsum(b.line_words * content)])[ends]) >= 0.5 * b.n_words
    held = [(r.quality, k) for r, k in zip(rows, kept.tolist()) if r.doc_id not in train]
    good, bad = [k for q, k in held if q == 1], [k for q, k in held if q == 0]
    print(len(good), sum(good) / len(good), len(bad), 1 - sum(bad) / len(bad))
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2
