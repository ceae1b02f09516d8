"""The steps of the repeat removers on chunks, without Spark: memory, and answers that do not depend on how much is done at once."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import chunks, substring_dedup, suffix_dedup
from logloom.llm.chunks import LAST_ID, Chunk, pack
from tests.llm import test_substring_dedup, test_suffix_dedup
from tests.llm.helpers import prose


def staged(rows, n):
    """The documents in ``n`` chunk rows."""
    out, sink = [], pa.BufferOutputStream()
    empty = pa.RecordBatch.from_arrays([], schema=pa.schema([]))
    with pa.ipc.new_stream(sink, empty.schema) as stream:
        stream.write_batch(empty)
    for k in range(n):
        part = [(i, (t or "").encode()) for i, t in rows[k::n]]
        out.append({
            "chunk": k, "doc_ids": np.array([LAST_ID if i is None else i for i, _ in part], np.int64).tobytes(),
            "nulls": np.packbits([i is None for i, _ in part]).tobytes(), "sizes": np.array([len(t) for _, t in part], np.int64).tobytes(),
            "texts": b"".join(t for _, t in part), "carry": sink.getvalue().to_pybytes(),
        })
    return out


def exchanged(rows, name, send, merge):
    """Add the answers of an exchange to the chunk rows."""
    runs, back = {}, [{} for _ in rows]
    for k, row in enumerate(rows):
        sent = list(send(Chunk(row)))
        assert [b for b, _ in sent] == sorted({b for b, _ in sent})
        for b, run in sent:
            runs.setdefault(b, []).append((k, run))
    for b, found in runs.items():
        for (k, _), reply in zip(found, merge([memoryview(run) for _, run in found], np.array([k for k, _ in found]))):
            back[k][b] = reply
    return [row | {f"answers_{name}": [pack([(b, k, r) for b, r in back[k].items()])]} for k, row in enumerate(rows)]


def results(rows, make):
    found = [dict(columns) for row in rows for columns in make(Chunk(row))]
    return sorted((x for columns in found for x in zip(*columns.values())), key=repr)


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def long_chunk():
    """4 MB of texts; few words come twice in the same surroundings."""
    rng = random.Random(1)
    words = [f"{rng.randrange(16 ** 5):x}" for _ in range(5000)]
    return staged([(i, " ".join(rng.choices(words, k=3500))) for i in range(210)], 1)[0]


@pytest.mark.parametrize("hot", [2, 1 << 16])
def test_suffix_steps_in_small_pieces(monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    for name, value in {"_PART": 20, "_DECODED": 1, "_ROWS": 7, "_BLOCK": 130, "STRETCH_ROWS": 50}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(chunks, "STRETCH_ROWS", 50)
    rows = test_suffix_dedup.cases() + [(200 + i, prose(1, 40 + i % 5)) for i in range(20)]
    for buckets in (1, 5):
        held = exchanged(staged(rows, 6), "grams", suffix_dedup._send_grams(buckets), suffix_dedup._merge_grams)
        held = exchanged(held, "suffixes", suffix_dedup._send_suffixes(buckets), suffix_dedup._merge_keys)
        assert results(held, suffix_dedup._results(buckets, False)) == test_suffix_dedup.brute(rows)


def test_merge_of_suffixes_needs_little_memory():
    """A bucket of which all is repeated: memory beside the runs does not follow its rows."""
    rng, runs = np.random.default_rng(1), []
    for k in range(4):
        keys = rng.integers(97, 123, (30_000, suffix_dedup.KEY)).astype(np.uint8)
        keys[:15_000] = np.random.default_rng(2).integers(97, 123, (15_000, suffix_dedup.KEY))
        keys[:, -2:] = suffix_dedup.LENGTH, suffix_dedup.LEFT
        keys = keys[np.lexsort(keys.T[::-1])]
        shared, rest = suffix_dedup.front_code(keys)
        runs.append(np.int64(len(keys)).tobytes() + np.full(len(keys), k, np.int64).tobytes() + shared.tobytes() + rest)
    answers = []
    assert peak_mb(lambda: answers.extend(suffix_dedup._merge_suffixes(runs))) < 35
    import zlib

    places = [np.frombuffer(zlib.decompress(a), "<u4") for a in answers]
    assert [int((p == (1 << suffix_dedup.PLACES) - 1).sum()) for p in places] == [0, 15_000, 15_000, 15_000]
    assert [int((p == 0).sum()) for p in places] == [30_000, 15_000, 15_000, 15_000]


def test_anchors_of_a_chunk_need_little_memory():
    row = long_chunk()
    assert 3 << 20 < len(row["texts"]) < 5 << 20
    assert peak_mb(lambda: [None for _ in suffix_dedup._send_grams(4)(Chunk(row))]) < 70


def windowed(rows, buckets):
    cells = substring_dedup.CELLS_PER_WORD * sum(len(row["texts"].split()) for row in rows)
    held = exchanged(rows, "cells", substring_dedup._send_cells(cells, buckets), substring_dedup._merge_cells)
    held = exchanged(held, "keys", substring_dedup._send_keys(cells, buckets), substring_dedup._merge_keys)
    return results(held, substring_dedup._results(cells, buckets))


@pytest.mark.parametrize("buckets", [1, 5])
def test_window_steps_in_small_pieces(monkeypatch, buckets):
    monkeypatch.setattr(chunks, "STRETCH_ROWS", 50)
    monkeypatch.setattr(substring_dedup, "_BLOCK", 30)
    rows = test_substring_dedup.distinct(test_suffix_dedup.cases() + [(200 + i, prose(1, 40 + i % 5)) for i in range(20)])
    assert windowed(staged(rows, 6), buckets) == test_substring_dedup.brute(rows)


def test_windows_of_one_doc_id_go_by_place():
    """Of rows with one doc_id the smaller place counts as earlier, whichever row stands first in the chunk."""
    repeat = prose(1, 30)
    found = windowed(staged([(1, f"{prose(2, 25)} {repeat}"), (1, repeat)], 1), 1)
    assert sorted(x[1:3] for x in found) == [(30, 0), (55, 30)]


def test_windows_of_a_chunk_need_little_memory():
    row = long_chunk()
    cells = substring_dedup.CELLS_PER_WORD * 210 * 3500
    assert peak_mb(lambda: [None for _ in substring_dedup._send_cells(cells, 1)(Chunk(row))]) < 100


def test_merges_of_windows_need_little_memory():
    """The sketch range and the keys of a bucket of 16 MB of text."""
    row = long_chunk()
    cells, n = substring_dedup.CELLS_PER_WORD * 4 * 210 * 3500, 500_000
    runs = [dict(substring_dedup._send_cells(cells, 1)(Chunk(row)))[0] for _ in range(2)]
    assert peak_mb(lambda: substring_dedup._merge_cells(runs * 2, None)) < 50
    high = np.sort(np.random.default_rng(1).integers(0, 1 << 63, n).astype(np.uint64))
    places = np.arange(n).astype(np.uint32)
    runs = [b"".join(x.tobytes() for x in (high, np.full(n, k), places, places)) for k in (2, 1, 3)]
    replies = []
    assert peak_mb(lambda: replies.extend(substring_dedup._merge_keys(runs, None))) < 30
    assert [int(np.unpackbits(np.frombuffer(r, np.uint8)).sum()) for r in replies] == [0, n, 0]
