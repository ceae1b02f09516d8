from __future__ import annotations

import functools
import zlib

import numpy as np
import pytest

from logloom.llm import packing, token_store
from logloom.llm.tokens import Encoder, default_vocabulary
from tests.llm.helpers import clashing, documents, prose

TEXTS = [
    (5, "Plain words, and more.\nNext line's end"), (2, None), (9, ""), (1, "  two  spaces \n\n end "), (7, "日本語 text ½ café x"),
    (3, "a <|endoftext|> b"), (4, prose(1, 5000)), (4, prose(1, 5000)), (None, "no id"), (6, "x" * 3000), (8, prose(2, 900)), (10, "don't\t\tstop\r\n1234 ²³"),
]


@functools.cache
def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def _ids(text):
    return [*_library().encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_library():
    encode = Encoder(default_vocabulary()).encode
    for _ in range(2):
        for (_, text), ids in zip(TEXTS, encode([t for _, t in TEXTS])):
            assert ids.tolist() == _ids(text)


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_round_trip(spark):
    got = token_store.store_and_read(clashing(documents(spark, TEXTS))).collect()
    want, start = [], 0
    for key, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = _ids(text)
        want.append((key, start, len(ids), _crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_foreign_keys_are_turned_away():
    keys = np.arange(0, 30_000, 3, dtype=np.int64)
    hashed = token_store.PerfectHash.build(keys.view(np.uint64))
    assert sorted(hashed.slots(keys.view(np.uint64))) == list(range(len(keys)))


def test_frequent_ids_fill_many_shards(spark):
    """NULL, one id and one row stand on many rows; extreme ids stay what they are."""
    from logloom.llm.common import Scratch

    rows = [(None, f"none {i} " + "x" * 50) for i in range(300)] + [(7, f"seven {i} " + "y" * 50) for i in range(300)] + [(8, "the same row again and again " * 3)] * 300
    rows += [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), ((1 << 53) + 1, "odd"), (1, None)]
    docs, scratch = documents(spark, rows).repartition(4), Scratch(spark, "test")
    manifest = token_store.write_tokens(docs, scratch, shard_bytes=4000)
    per_shard = [r["count"] for r in manifest.groupBy("shard").count().collect()]
    assert len(per_shard) >= 15 and max(per_shard) < 200
    got = sorted(map(tuple, token_store.read_tokens(manifest).collect()), key=lambda r: r[1])
    start, keys = 0, []
    for key, at, n, _ in got:
        assert at == start
        start += n
        keys.append(key)
    assert keys == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    ids = {t: _ids(t) for _, t in rows}
    assert sorted((str(k), n, crc) for k, _, n, crc in got) == sorted((str(k), len(ids[t]), _crc(ids[t])) for k, t in rows)


def test_keys_of_no_document_are_not_found(spark, tmp_path):
    from logloom.llm.common import Scratch

    docs = documents(spark, [(k, f"text {k}") for k in range(0, 3000, 3)])
    manifest = token_store.write_tokens(docs, Scratch(spark, "test"), shard_bytes=1 << 30)
    shard = token_store.Shard(manifest.first()["file"])
    own = np.arange(0, 3000, 3, dtype=np.int64)
    assert (shard.find(own, np.zeros(len(own), np.int64)) >= 0).all()
    foreign = np.arange(1, 300_000, 3, dtype=np.int64)
    assert (shard.find(foreign, np.zeros(len(foreign), np.int64)) >= 0).sum() <= 2  # fingerprints have 32 bits
    assert (shard.find(own, np.ones(len(own), np.int64)) < 0).all()


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert token_store.store_and_read(empty).count() == 0
    assert packing.pack(empty).count() == 0


def test_packing(spark):
    rows = packing.pack(clashing(documents(spark, TEXTS + [(100 + i, prose(i, 20 + 37 * i)) for i in range(40)]))).collect()
    texts = {}
    for key, text in TEXTS + [(100 + i, prose(i, 20 + 37 * i)) for i in range(40)]:
        texts.setdefault(key, []).append(_ids(text))
    pieces, sequences = {}, {}
    for r in rows:
        ids = texts[r.doc_id][0][r.start:r.start + r.length]
        assert _crc(ids) == r.ids_crc32 and r.length == len(ids) <= 2048
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, all_ids in texts.items():
        n = len(all_ids[0])
        starts = packing.cut_points(n)
        want = [(k, a, b - a) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n]))]
        assert sorted(pieces[key]) == sorted(want * len(all_ids))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) * 1.05 + 1


@pytest.mark.parametrize("seed", range(3))
def test_crossover_keeps_items(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 900, 500)
    a, b = (packing.best_fit(lengths, rng.permutation(500), 1000) for _ in range(2))
    child = packing.crossover(lengths, a, b, 1000, rng)
    assert (child >= 0).all() and np.bincount(child, lengths).max() <= 1000
    best = packing.evolve(lengths, [], 1000, seed)
    plain = packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 1000)
    assert packing.fitness(lengths, best, 1000) >= packing.fitness(lengths, plain, 1000)
