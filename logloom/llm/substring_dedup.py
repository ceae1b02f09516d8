"""Removal of repeated 20-word windows with a count-min prefilter.

A word goes if a window of 20 words over it also starts earlier: in a document with a smaller doc_id, or in
the same document before it.

1. Every chunk counts its windows in a partition sketch: two rows of saturating counters, a cell for each row
   chosen by a hash. The sketch has eight cells for each word of the corpus and row, so it grows with the input,
   and it is cut into ranges of cells: a chunk sends its occupied cells of a range, the range adds up all chunks
   in its counters and answers which cells reached two. Counters only ever overestimate, so no repeated window is lost.
2. Windows whose cells all reached two are grouped exactly. A chunk sends each such window once, as 96 bits of
   two independent hashes of its words with its first place, and learns whether that place is the first of all.

The words are compared by 64-bit hashes of each word, combined twice with random odd multipliers, so two
different windows fall together with a chance of about 1 in 10^28 per pair.

Edge cases: a NULL text has no words; a NULL doc_id ranks as 2^63 - 1, the largest; of rows with one doc_id
and one place the one staged first counts as earlier; texts below 20 words stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.chunks import CHUNK_BYTES, Chunk, Routes, bucket_count, exchange, over_chunks, range_bucket, save, split_runs, stage_chunks, stretches, with_answers
from logloom.llm.common import Scratch, mix64

WINDOW = 20
SKETCH_ROWS = 2
CELLS_PER_WORD = 8
_BLOCK = 1 << 16
_FACTORS = mix64(np.arange(1, 2 * WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
ROWS = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class Windows:
    """The two hashes of every window of a chunk, with its document and place; words are hashed a block at a time."""

    def __init__(self, chunk: Chunk):
        counts, found, block = [], [], []
        for text in chunk.texts():
            words = text.split()
            counts.append(len(words))
            for at in range(0, len(words), _BLOCK):
                block += words[at:at + _BLOCK]
                if len(block) >= _BLOCK:
                    found.append(_word_hashes(block))
                    block = []
        found.append(_word_hashes(block))
        hashes = np.concatenate(found)
        del found, block
        self.counts, self.doc_ids = np.array(counts, np.int64), chunk.doc_ids
        self.begin = np.cumsum(self.counts) - self.counts
        room = np.maximum(self.counts - WINDOW + 1, 0)
        self.number = np.repeat(np.arange(len(self.counts), dtype=np.int32), room)
        self.start = np.arange(int(room.sum())) + np.repeat(self.begin - (np.cumsum(room) - room), room)
        self.first, self.second = np.empty(len(self.start), np.uint64), np.empty(len(self.start), np.uint64)
        for at in range(0, len(self.start), _BLOCK):
            start = self.start[at:at + _BLOCK]
            some = hashes[start[0]:start[-1] + WINDOW]
            n = len(some) - WINDOW + 1
            for row, out in enumerate((self.first, self.second)):
                total = np.zeros(n, np.uint64)
                for k in range(WINDOW):
                    total += some[k:k + n] * _FACTORS[row * WINDOW + k]
                out[at:at + _BLOCK] = mix64(total[start - start[0]])

    def doc(self, chosen: np.ndarray) -> np.ndarray:
        return self.doc_ids[self.number[chosen]]

    def place(self, chosen: np.ndarray) -> np.ndarray:
        return self.start[chosen] - self.begin[self.number[chosen]]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[codes]


def _cells(windows: Windows, row: int, cells: int) -> np.ndarray:
    return mix64(windows.first ^ np.uint64(row * 0x632BE59BD9B4E019 + 7)) % np.uint64(cells)


def _row_cells(windows: Windows, row: int, cells: int, buckets: int):
    """Windows by their cells of a sketch row; where the occupied cells begin, these in ascending order, whether they
    have two windows here, and their buckets."""
    cell = _cells(windows, row, cells)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    twice, cell = np.diff(first, append=len(cell)) > 1, cell[first]
    return order, first, cell, twice, (cell * np.uint64(buckets) // np.uint64(cells)).astype(np.int64) + row * buckets


def _send_cells(cells: int, buckets: int):
    def send(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        windows = Windows(chunk)
        for row in range(SKETCH_ROWS):
            _, _, cell, twice, bucket = _row_cells(windows, row, cells, buckets)
            for b, s, e in split_runs(bucket):
                steps = np.diff(cell[s:e], prepend=cell[s]).astype(np.uint64)
                wide = 2 if steps.max() < 1 << 16 else 4 if steps.max() < 1 << 32 else 8
                head = np.array([e - s, wide, int(cell[s])], np.int64).tobytes()
                run = head + steps.astype(f"<u{wide}").tobytes() + np.packbits(twice[s:e]).tobytes()
                yield b, run

    return send


def _merge_cells(runs: list[bytes], _: np.ndarray) -> list[bytes]:
    """Add the partial sketches of one range of cells; bits of the cells that reached two."""

    def cells(run: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, wide, start = np.frombuffer(run, np.int64, 3).tolist()
        steps = np.frombuffer(run, f"<u{wide}", n, 24)
        twice = np.unpackbits(np.frombuffer(run, np.uint8, -1, 24 + n * wide), count=n)
        return np.cumsum(steps, dtype=np.uint64).astype(np.int64) + (start - least), twice

    heads = [np.frombuffer(run, np.int64, 3).tolist() for run in runs]
    least = min(start for _, _, start in heads)
    most = max(start + int(np.frombuffer(run, f"<u{wide}", n, 24).sum(dtype=np.uint64)) for run, (n, wide, start) in zip(runs, heads))
    counter = np.zeros(most - least + 1, np.uint8)  # the range has eight cells for each of its share of the words
    for run in runs:
        cell, twice = cells(run)
        counter[cell] = np.minimum(counter[cell] + 1 + twice, 2)
    return [np.packbits(counter[cells(run)[0]] > 1).tobytes() for run in runs]


def _answer_bits(answers: dict[int, bytes], bucket: np.ndarray) -> np.ndarray:
    bits = [np.unpackbits(np.frombuffer(answers[b], np.uint8), count=e - s) for b, s, e in split_runs(bucket)]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def _estimated(chunk: Chunk, windows: Windows, cells: int, buckets: int) -> np.ndarray:
    """Numbers of the windows whose cells reached two in every row of the sketch."""
    repeated = np.ones(len(windows.start), bool)
    for row in range(SKETCH_ROWS):
        order, first, _, _, bucket = _row_cells(windows, row, cells, buckets)
        repeated[order] &= np.repeat(_answer_bits(chunk.answers["answers_cells"], bucket), np.diff(first, append=len(order)))
    return np.flatnonzero(repeated)


class Keys:
    """Distinct keys of the estimated windows: bucket, key, and the first window here."""

    def __init__(self, windows: Windows, chosen: np.ndarray, buckets: int):
        chosen = chosen[np.lexsort([windows.place(chosen), windows.doc(chosen)])]
        order = np.lexsort([windows.second[chosen] >> np.uint64(32), windows.first[chosen]])
        self.chosen = chosen[order]
        high, low = windows.first[self.chosen], (windows.second[self.chosen] >> np.uint64(32)).astype(np.uint32)
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.of, self.is_first = np.cumsum(new) - 1, new
        self.high, self.low = high[first], low[first]
        self.doc, self.place = windows.doc(self.chosen[first]), windows.place(self.chosen[first])
        self.bucket = range_bucket(self.high >> np.uint64(32), buckets)


def _send_keys(cells: int, buckets: int):
    def send(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        windows = Windows(chunk)
        keys = Keys(windows, _estimated(chunk, windows, cells, buckets), buckets)
        for b, s, e in split_runs(keys.bucket):
            parts = (keys.high[s:e], keys.doc[s:e], keys.low[s:e], keys.place[s:e].astype(np.uint32))
            yield b, b"".join(p.tobytes() for p in parts)

    return send


def _merge_keys(runs: list[bytes], _: np.ndarray) -> list[bytes]:
    """Bits of the windows whose first place of all is the one that the run holds."""
    sizes = [len(r) // 24 for r in runs]
    columns = [
        [np.frombuffer(r, kind, n, at * n) for r, n in zip(runs, sizes)]
        for kind, at in ((np.uint64, 0), (np.int64, 8), (np.uint32, 16), (np.uint32, 20))
    ]
    ends = np.cumsum(sizes)
    first = np.empty(int(ends[-1]), bool)
    for cuts in stretches(columns[0]):
        high, doc, low, place = (np.concatenate([x[s:e] for x, (s, e) in zip(column, cuts)]) for column in columns)
        if not len(high):
            continue
        at = np.concatenate([np.arange(s, e) + end - n for (s, e), end, n in zip(cuts, ends.tolist(), sizes)])
        order = np.lexsort([place, doc, low, high])  # stable: runs come in chunk order
        high, low = high[order], low[order]
        first[at[order]] = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    return [np.packbits(x).tobytes() for x in np.split(first, ends[:-1])]


def _results(cells: int, buckets: int):
    def results(chunk: Chunk) -> Iterator[dict]:
        windows = Windows(chunk)
        keys = Keys(windows, _estimated(chunk, windows, cells, buckets), buckets)
        earliest = _answer_bits(chunk.answers["answers_keys"], keys.bucket)
        gone = keys.chosen[~(keys.is_first & earliest[keys.of])] if len(keys.of) else keys.chosen
        cover = np.zeros(int(windows.counts.sum()) + 1, np.int32)
        np.add.at(cover, windows.start[gone], 1)
        np.add.at(cover, windows.start[gone] + WINDOW, -1)
        np.cumsum(cover, out=cover)
        counts, kept = windows.counts.tolist(), cover[:-1] == 0
        del windows, keys, earliest, gone, cover
        out, at = {n: [] for n in ("n_words", "n_removed", "kept_sha256")}, 0
        for text, n in zip(chunk.texts(), counts):
            words, stay = text.split(), kept[at:at + n]
            at += n
            left = int(np.count_nonzero(stay))
            text = b" ".join(words if left == n else compress(words, stay.tolist()))
            out["n_words"].append(n)
            out["n_removed"].append(n - left)
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
        yield {"doc_id": chunk.ids()} | out

    return results


def remove_windows(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "windows")
    chunks = stage_chunks(docs, scratch, chunk_bytes=chunk_bytes)
    buckets, n_chunks = bucket_count(chunks), chunks.count()
    cells = CELLS_PER_WORD * max(1, chunks.agg(F.sum("n_words")).first()[0] or 0)
    sketch = exchange(chunks, scratch, "cells", Routes(SKETCH_ROWS * buckets, n_chunks), _send_cells(cells, buckets), _merge_cells)
    estimated = with_answers(chunks, sketch, "answers_cells")
    first = exchange(estimated, scratch, "keys", Routes(buckets, n_chunks), _send_keys(cells, buckets), _merge_keys)
    answered = with_answers(estimated, first, "answers_keys")
    result = save(scratch, over_chunks(answered, _results(cells, buckets), ROWS), "results")
    scratch.drop("chunks", "cells", "keys")
    return result
