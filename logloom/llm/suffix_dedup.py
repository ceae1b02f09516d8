"""Exact removal of byte strings that an earlier document holds, by merging sorted suffix runs.

A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id. Sorting all suffixes
would move each text some twenty times over, so the suffix array is sparse, without losing a match: every
50-byte string is represented by its anchor, the position within it where an 8-byte hash is least. Equal
strings have their anchors at equal places, so a string repeats exactly if its anchor's surroundings repeat.

1. A first exchange sends a hash of the 24 bytes at each anchor and learns which occur in two documents.
2. Only such anchors send their suffix (50 bytes, followed by the 26 bytes before it, read backwards). A chunk's
   suffixes form a sorted run per bucket, front-coded: each is stored as the length of the prefix shared with
   its predecessor and the rest. A bucket combines its runs with a loser tree that keeps, for every run, the
   known common prefix with the last suffix put out: the run with the longer one wins without a comparison, and
   equal ones are compared behind it only.
   Runs are decoded and merged a stretch at a time, so a bucket takes little more than its coded runs, whatever repeats.
3. The merged order gives groups of common right parts, and the sorted left parts groups of common left parts;
   from both follows, for each of the 27 places of a string around its anchor, the smallest doc_id that has it.
   The answer is one bit per place and suffix.

Chunks keep one row per distinct suffix, so a passage that thousands of documents share travels once per chunk.

All suffixes of one 24-byte gram belong together and would meet in one task, however many texts hold the gram with
other texts around it. The first exchange counts anchors per gram, and anchors of a gram with ``HOT`` or more send
the strings that they stand for instead of a suffix: 128 bits of hash and the smallest doc_id of each distinct string
of a chunk. These spread over all buckets by their own hash, and a bucket answers which strings an earlier document
has, one bit each. Two different strings fall together with a chance of about 1 in 10^38 per pair.

Edge cases: a NULL text is empty; a NULL doc_id ranks as 2^63 - 1, the largest; rows with equal doc_id do not
remove each other's bytes; texts below 50 bytes stay; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame

from logloom.llm.chunks import CHUNK_BYTES, STRETCH_ROWS, Chunk, Routes, bucket_count, exchange, over_chunks, range_bucket, save, split_runs, stage_chunks, stretches, with_answers
from logloom.llm.common import Scratch, mix64, tasks_for

LENGTH = 50
GRAM = 24
PLACES = LENGTH - GRAM + 1
LEFT = PLACES - 1
KEY = LENGTH + LEFT + 2
# Anchors of one gram from which on its strings are spread by their own hashes.
HOT = 1 << 16
_BLOCK = 1 << 18
# Rows of bytes that are picked from a text at once: picking takes eight bytes of place for each.
_ROWS = 1 << 14
# Anchors whose keys or strings are made at once, and merged rows that are answered at once, up to the end of a bucket or gram.
_PART = 1 << 15
# Rows that are decoded at once of all runs that are merged, and of one run: decoding takes some 2 KB for each.
_DECODED = 1 << 16
_DECODED_RUN = 1 << 11
_BYTE_CODES = (mix64(np.arange(256, dtype=np.uint64) + np.uint64(11)) >> np.uint64(32)).astype(np.uint32)
ROWS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _place_hash(text: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 8 bytes from each position (fewer positions at the end)."""
    h = _BYTE_CODES[text]
    for step, factor in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D)):
        h = h[:-step] * np.uint32(factor) + h[step:]
        h ^= h >> np.uint32(15)
    return h


def _least(values: np.ndarray) -> np.ndarray:
    """Minimum of each ``PLACES`` consecutive values."""
    step, m = 1, values
    while step * 2 <= PLACES:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = PLACES - step
    return np.minimum(m[:-rest], m[rest:]) if rest else m


class Anchors:
    """Anchors of a chunk: position, first and last start of the strings they stand for, document."""

    def __init__(self, chunk: Chunk):
        self.text = text = np.frombuffer(chunk.raw, np.uint8)
        begin = chunk.ends - chunk.sizes
        long = np.flatnonzero(chunk.sizes >= LENGTH)
        first, behind = begin[long], chunk.ends[long] - LENGTH + 1
        found = []
        for at in range(0, max(0, len(text) - LENGTH + 1), _BLOCK):
            part = text[at:at + _BLOCK + LENGTH - 1]
            starts = len(part) - LENGTH + 1
            some = slice(np.searchsorted(behind, at, side="right"), np.searchsorted(first, at + starts))
            inside = np.zeros(starts + 1, np.int32)
            np.add.at(inside, np.maximum(first[some] - at, 0), 1)
            np.add.at(inside, np.minimum(behind[some] - at, starts), -1)
            start = np.flatnonzero(np.cumsum(inside[:-1]) > 0) + at
            if not len(start):
                continue
            h = _place_hash(part)[: starts + PLACES - 1].astype(np.uint64) << np.uint64(32)
            h |= np.arange(at, at + len(h), dtype=np.uint64)
            anchor = (_least(h)[start - at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            found.append((anchor[new], start[new], start[np.append(new[1:], len(anchor)) - 1]))
        if not found:
            self.at = self.low = self.high = self.doc = self.begin = self.end = np.zeros(0, np.int64)
            self.gram, self.hot = np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        # An anchor of two blocks is one.
        anchor, low, high = (np.concatenate(x) for x in zip(*found))
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        self.at, self.low, self.high = anchor[new], low[new], high[np.append(new[1:], len(anchor)) - 1]
        number = np.searchsorted(chunk.ends, self.at, side="right")
        self.doc = chunk.doc_ids[number]
        self.begin, self.end = begin[number], chunk.ends[number]
        self.gram, self.hot = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), bool)
        for s in range(0, len(self.at), _ROWS):
            grams, h = text[self.at[s:s + _ROWS, None] + np.arange(GRAM)].view(np.uint64), self.gram[s:s + _ROWS]
            for k in range(GRAM // 8):
                h[:] = mix64(h * np.uint64(0x9E3779B97F4A7C15) + grams[:, k])

    def take(self, chosen: np.ndarray) -> Anchors:
        taken = copy.copy(self)
        for name in ("at", "low", "high", "doc", "begin", "end", "gram", "hot"):
            setattr(taken, name, getattr(self, name)[chosen])
        return taken


def _grams(anchors: Anchors, buckets: int):
    """Distinct grams in ascending order with their bucket and whether two documents here hold them."""
    order = np.argsort(anchors.gram, kind="stable")
    gram = anchors.gram[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    doc = anchors.doc[order]
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    distinct = gram[first]
    return order, first, distinct, several, range_bucket(distinct >> np.uint64(32), buckets)


def _send_grams(buckets: int):
    def send(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        anchors = Anchors(chunk)
        if not len(anchors.at):
            return
        order, first, gram, several, bucket = _grams(anchors, buckets)
        count = np.diff(np.append(first, len(order)))
        for b, s, e in split_runs(bucket):
            part, often = gram[s:e], count[s:e] > 1
            counts = (count[s:e][often] << 1 | several[s:e][often]).astype("<u4")
            run = (part >> np.uint64(8)).astype("<u4").tobytes() + (part & np.uint64(255)).astype(np.uint8).tobytes()
            yield b, np.int64(e - s).tobytes() + run + np.packbits(often).tobytes() + counts.tobytes()

    return send


def _merge_grams(runs: list[bytes], _: np.ndarray) -> list[bytes]:
    """Bits of the grams that two documents hold, and of those that are hot."""
    sizes = [int(np.frombuffer(run, np.int64, 1)[0]) for run in runs]
    ends, total = np.cumsum(sizes), sum(sizes)
    gram, count, several = np.empty(total, np.uint64), np.ones(total, np.uint32), np.zeros(total, bool)
    for run, end, n in zip(runs, ends.tolist(), sizes):
        here, bits = slice(end - n, end), (n + 7) // 8
        gram[here] = np.frombuffer(run, "<u4", n, 8).astype(np.uint64) << np.uint64(8) | np.frombuffer(run, np.uint8, n, 8 + 4 * n)
        often = np.unpackbits(np.frombuffer(run, np.uint8, bits, 8 + 5 * n), count=n).astype(bool)
        more = np.frombuffer(run, "<u4", -1, 8 + 5 * n + bits)
        count[here][often], several[here][often] = more >> 1, (more & 1).astype(bool)
    repeated, hot, parts = np.empty(total, bool), np.empty(total, bool), tasks_for(total, STRETCH_ROWS)
    for k in range(parts):  # grams are hashes, so their remainders are even
        at = np.flatnonzero(gram % np.uint64(parts) == k)
        if not len(at):
            continue
        at = at[np.argsort(gram[at])]
        ranked = gram[at]
        edge = np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])
        again = ~(edge[:-1] & edge[1:]) | several[at]
        anchors = np.add.reduceat(count[at].astype(np.int64), np.flatnonzero(edge[:-1]))
        repeated[at] = again
        hot[at] = again & (anchors >= HOT)[np.cumsum(edge[:-1]) - 1]
    return [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(repeated, ends[:-1]), np.split(hot, ends[:-1]))]


def _repeated(chunk: Chunk, buckets: int) -> Anchors:
    """The anchors whose gram the first exchange found in two documents, and which of them are hot."""
    anchors = Anchors(chunk)
    if not len(anchors.at):
        return anchors
    order, first, _, _, bucket = _grams(anchors, buckets)
    answers = chunk.answers["answers_grams"]
    flags = np.concatenate([
        np.unpackbits(np.frombuffer(answers[b], np.uint8).reshape(2, -1), axis=1, count=e - s) for b, s, e in split_runs(bucket)
    ], axis=1).astype(bool)
    chosen = np.zeros((2, len(order)), bool)
    chosen[:, order] = np.repeat(flags, np.diff(np.append(first, len(order))), axis=1)
    anchors.hot = chosen[1]
    return anchors.take(np.flatnonzero(chosen[0]))


class Suffixes:
    """Distinct suffix keys of anchors by bucket and key, with the smallest doc_id and where they occur."""

    def __init__(self, anchors: Anchors, buckets: int):
        self.anchors = anchors
        text, at = anchors.text, anchors.at
        n = len(at)
        padded = np.zeros((n, -(-KEY // 8) * 8), np.uint8)
        keys = padded[:, :KEY]
        right, left = np.minimum(anchors.end - at, LENGTH), np.minimum(at - anchors.begin, LEFT)
        ahead, back = np.arange(LENGTH), np.arange(1, LEFT + 1)
        for s in range(0, n, _ROWS):
            part, here, r, l = keys[s:s + _ROWS], at[s:s + _ROWS, None], right[s:s + _ROWS, None], left[s:s + _ROWS, None]
            part[:, :LENGTH] = np.where(ahead < r, text[np.minimum(here + ahead, len(text) - 1)], 0)
            part[:, LENGTH:LENGTH + LEFT] = np.where(back <= l, text[np.maximum(here - back, 0)], 0)
        keys[:, -2], keys[:, -1] = right, left
        bucket = range_bucket(anchors.gram >> np.uint64(32), buckets)
        words, order = padded.view(">u8"), np.arange(n)
        for k in range(words.shape[1] - 1, -1, -1):  # a lexsort that holds one word of the keys at a time
            order = order[np.argsort(words[order, k].astype(np.uint64), kind="stable")]
        order = order[np.argsort(bucket[order], kind="stable")]
        keys, bucket = keys[order], bucket[order]
        del padded, words
        shared = common_prefix(keys[1:], keys[:-1]) if n else np.zeros(0, np.int64)
        new = np.concatenate([[True], (shared < KEY) | (bucket[1:] != bucket[:-1])]) if n else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.of = np.empty(n, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.keys, self.bucket = keys[first], bucket[first]
        self.least = np.minimum.reduceat(anchors.doc[order], first) if n else np.zeros(0, np.int64)


def _suffixes(anchors: Anchors, buckets: int) -> Iterator[Suffixes]:
    """The suffixes of a chunk, some buckets at a time."""
    bucket = range_bucket(anchors.gram >> np.uint64(32), buckets)
    for part in _parts(bucket):
        yield Suffixes(anchors.take(part), buckets)


def _parts(values: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the rows in ascending order of their values, some ``_PART`` at a time and all of a value together."""
    order, at = np.argsort(values, kind="stable"), 0
    ranked = values[order]
    while at < len(order):
        end = int(np.searchsorted(ranked, ranked[min(at + _PART, len(order)) - 1], side="right"))
        yield order[at:end]
        at = end


class Strings:
    """Distinct strings that hot anchors stand for, by hash, with the smallest doc_id.

    Equal strings have equal grams, so they are made and told apart some grams at a time.
    """

    def __init__(self, anchors: Anchors, buckets: int):
        self.anchors, self.parts = anchors, list(_parts(anchors.gram))
        found = [self._made(part)[2:] for part in self.parts] or [(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)]
        high, low, least = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort([low, high])
        self.high, self.low, self.least = high[order], low[order], least[order]
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.bucket = range_bucket(self.high >> np.uint64(32), buckets)

    def _made(self, part: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts of the strings of some anchors and which distinct one each is; hashes and smallest doc_ids of these."""
        anchors = self.anchors.take(part)
        room = anchors.high - anchors.low + 1
        starts = np.repeat(anchors.low - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
        n = len(starts)
        both = np.zeros((2, n), np.uint64)
        for at in range(0, n, _ROWS):
            start = starts[at:at + _ROWS]
            padded = np.zeros((len(start), -(-LENGTH // 8) * 8), np.uint8)
            padded[:, :LENGTH] = anchors.text[start[:, None] + np.arange(LENGTH)]
            words = padded.view(np.uint64)
            for row, factor in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
                h = both[row, at:at + _ROWS]
                for k in range(words.shape[1]):
                    h[:] = mix64(h * np.uint64(factor) + words[:, k] + np.uint64(row))
        order = np.lexsort([both[1], both[0]])
        high, low = both[0][order], both[1][order]
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        first = np.flatnonzero(new)
        of = np.empty(n, np.int64)
        of[order] = np.cumsum(new) - 1
        return starts, of, high[first], low[first], np.minimum.reduceat(np.repeat(anchors.doc, room)[order], first)

    def gone(self, earlier: np.ndarray) -> Iterator[np.ndarray]:
        """Starts of the strings that an earlier document has; ``earlier`` than the chunk's first, for each distinct one."""
        before = 0
        for part in self.parts:
            starts, of, high, _, _ = self._made(part)
            own = self.rank[before:before + len(high)][of]
            room = self.anchors.high[part] - self.anchors.low[part] + 1
            yield starts[earlier[own] | (np.repeat(self.anchors.doc[part], room) > self.least[own])]
            before += len(high)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    out = np.empty(len(a), np.int64)
    for s in range(0, len(a), _ROWS):
        differ = a[s:s + _ROWS] != b[s:s + _ROWS]
        out[s:s + _ROWS] = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return out


def front_code(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths of sorted rows with their predecessors, and the remaining bytes."""
    shared = np.zeros(len(keys), np.int64)
    shared[1:] = common_prefix(keys[1:], keys[:-1])
    return shared.astype(np.uint8), keys[np.arange(keys.shape[1]) >= shared[:, None]].tobytes()


def front_decode(shared: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    """Inverse of ``front_code``: a byte is the one of the last row that stored it."""
    stored = np.arange(width) >= shared[:, None]
    at = np.cumsum(stored).reshape(stored.shape) - 1
    return rest[np.maximum.accumulate(np.where(stored, at, 0), axis=0)]


def decoded(shared: np.ndarray, rest: np.ndarray, width: int, rows: int) -> Iterator[tuple[int, int]]:
    """The rows of ``front_code`` as numbers, with their shared prefix lengths; ``rows`` of them are decoded at once."""
    last, at = np.zeros(0, np.uint8), 0
    for s in range(0, len(shared), rows):
        part = shared[s:s + rows].astype(np.int64)
        size, ahead = int((width - part).sum()), int(s > 0)
        keys = front_decode(np.concatenate([[0] * ahead, part]).astype(np.int64), np.concatenate([last, rest[at:at + size]]), width)[ahead:]
        last, at, raw = keys[-1].copy(), at + size, keys.tobytes()
        del keys
        for i, k in enumerate(part.tolist()):
            yield int.from_bytes(raw[i * width:(i + 1) * width], "big"), k


def _join(first: bytes, second: bytes) -> bytes:
    return np.int64(len(first)).tobytes() + first + second


def _split(both: bytes) -> tuple[bytes, bytes]:
    end = 8 + int(np.frombuffer(both, np.int64, 1)[0])
    return both[8:end], both[end:]


def _send_suffixes(buckets: int):
    def send(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        anchors = _repeated(chunk, buckets)

        def sorted_out() -> Iterator[tuple[int, int, bytes]]:
            for suffixes in _suffixes(anchors.take(~anchors.hot), buckets):
                for b, s, e in split_runs(suffixes.bucket):
                    shared, rest = front_code(suffixes.keys[s:e])
                    yield b, 0, np.int64(e - s).tobytes() + suffixes.least[s:e].tobytes() + shared.tobytes() + rest

        def hashed() -> Iterator[tuple[int, int, bytes]]:
            strings = Strings(anchors.take(anchors.hot), buckets)
            for b, s, e in split_runs(strings.bucket):
                yield b, 1, b"".join(part[s:e].tobytes() for part in (strings.high, strings.low, strings.least))

        for b, kinds in groupby(heapq.merge(sorted_out(), hashed()), key=lambda x: x[0]):
            both = {kind: run for _, kind, run in kinds}
            yield b, _join(both.get(0, b""), both.get(1, b""))

    return send


def merge_runs(runs: list[Iterator[tuple[int, int]]], width: int) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs of ``width``-byte numbers, each with the length of the prefix it shares with the one before:
    the run of each output row, the length of the prefix that the row shares with the row before it, and the row.

    A loser tree over runs. Beside each run stands the length of the prefix that its head shares with the last
    output; a longer one means a smaller head. Heads are compared only if these lengths are equal.
    """
    leaves = 1 << max(0, len(runs) - 1).bit_length()
    bits, none = width * 8, (0, -1)
    first = [next(run, none) for run in runs] + [none] * (leaves - len(runs))
    head, known = [key for key, _ in first], [-1 if k < 0 else 0 for _, k in first]
    loser = [0] * leaves

    def play(node: int) -> int:
        if node >= leaves:
            return node - leaves
        a, b = play(2 * node), play(2 * node + 1)
        if known[a] < known[b] or (known[a] == known[b] >= 0 and head[b] < head[a]):
            a, b = b, a
        if known[b] >= 0:
            known[b] = (bits - (head[a] ^ head[b]).bit_length()) >> 3
        loser[node] = b
        return a

    winner = play(1) if leaves > 1 else 0
    while known[winner] >= 0:
        yield winner, known[winner], head[winner]
        head[winner], k = next(runs[winner], none)
        node = (winner + leaves) >> 1
        while node:
            other = loser[node]
            o = known[other]
            if o > k:
                loser[node], known[winner] = winner, k
                winner, k = other, o
            elif o == k and 0 <= k < width:
                a, b = head[winner], head[other]
                common = (bits - (a ^ b).bit_length()) >> 3
                if b < a:
                    loser[node], known[winner] = winner, common
                    winner = other
                else:
                    known[other] = common
            node >>= 1
        known[winner] = k


def merge_sorted(keys: list[list[int]], shared: list[list[int]], width: int) -> tuple[list[int], list[int]]:
    """``merge_runs`` of lists: the run and the shared prefix length of every output row."""
    out = list(merge_runs([zip(k, s) for k, s in zip(keys, shared)], width))
    return [run for run, _, _ in out], [prefix for _, prefix, _ in out]


def _least_by_place(keys: np.ndarray, prefix: np.ndarray, least: np.ndarray) -> Iterator[np.ndarray]:
    """For each place of a string around its anchor, the smallest doc_id that holds the string."""
    lone = np.concatenate([prefix[1:] < GRAM, [True]]) & (prefix < GRAM)
    some = np.flatnonzero(~lone)
    right, left = keys[some, -2], keys[some, -1]
    near = prefix[some]
    behind = keys[some, LENGTH:LENGTH + LEFT]
    by_left = np.lexsort([behind[:, k] for k in range(LEFT - 1, -1, -1)]) if len(some) else np.zeros(0, np.int64)
    shared_left = np.zeros(len(some), np.int64)
    shared_left[1:] = common_prefix(behind[by_left][1:], behind[by_left][:-1]) if len(some) else 0
    for place in range(PLACES):
        out = least.copy()
        fits = np.flatnonzero((right >= LENGTH - place) & (left >= place))
        if len(fits):
            group = np.cumsum(near < LENGTH - place)
            side = np.empty(len(some), np.int64)
            side[by_left] = np.cumsum(shared_left < place)
            both = group[fits] * (len(some) + 1) + side[fits]
            order = np.argsort(both, kind="stable")
            ranked = both[order]
            first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            lowest = np.minimum.reduceat(least[some[fits[order]]], np.flatnonzero(first))
            out[some[fits[order]]] = lowest[np.cumsum(first) - 1]
        yield out


def _merge_keys(runs: list[bytes], _: np.ndarray) -> list[bytes]:
    """Answers to the suffixes and strings of each run."""
    suffixes, strings = zip(*map(_split, runs))
    places = iter(_merge_suffixes([r for r in suffixes if r])) if any(suffixes) else iter(())
    return [_join(next(places) if r else b"", bits) for r, bits in zip(suffixes, _merge_strings(strings))]


def _merge_strings(runs: tuple[bytes, ...]) -> list[bytes]:
    """Bits of the strings that a document before the run's first holds."""
    sizes = [len(r) // 24 for r in runs]
    if not sum(sizes):
        return [b""] * len(runs)
    highs, lows, leasts = (
        [np.frombuffer(r, kind, n, 8 * n * at) if n else np.zeros(0, kind) for r, n in zip(runs, sizes)]
        for at, kind in enumerate((np.uint64, np.uint64, np.int64))
    )
    ends = np.cumsum(sizes)
    earlier = np.empty(int(ends[-1]), bool)
    for cuts in stretches(highs):
        high, low, own = (np.concatenate([x[s:e] for x, (s, e) in zip(columns, cuts)]) for columns in (highs, lows, leasts))
        if not len(high):
            continue
        at = np.concatenate([np.arange(s, e) + end - n for (s, e), end, n in zip(cuts, ends.tolist(), sizes)])
        order = np.lexsort([low, high])
        high, low, own = high[order], low[order], own[order]
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        earlier[at[order]] = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1] < own
    return [np.packbits(x).tobytes() for x in np.split(earlier, ends[:-1])]


def _merge_suffixes(runs: list[bytes]) -> list[bytes]:
    """For each suffix of each run the places, as bits, at which an earlier document holds the string.

    Rows are decoded and answered as the merge comes to them, some ``_PART`` at a time and all of a gram together.
    """
    least, coded, sizes = [], [], []
    rows = min(max(16, _DECODED // len(runs)), _DECODED_RUN)
    for run in runs:
        n = int(np.frombuffer(run, np.int64, 1)[0])
        least.append(np.frombuffer(run, np.int64, n, 8))
        coded.append(decoded(np.frombuffer(run, np.uint8, n, 8 + 8 * n), np.frombuffer(run, np.uint8, -1, 8 + 9 * n), KEY, rows))
        sizes.append(n)
    ends = np.cumsum(sizes)
    taken = ends - sizes
    result = np.empty(int(ends[-1]), "<u4")

    def settle() -> None:
        of_run, shared = np.array(order), np.array(prefix)
        # The k-th output row of a run is its k-th row.
        by_run = np.argsort(of_run, kind="stable")
        count = np.bincount(of_run, minlength=len(runs))
        back = np.empty(len(of_run), np.int64)
        back[by_run] = np.repeat(taken - (np.cumsum(count) - count), count) + np.arange(len(of_run))
        own = np.empty(len(of_run), np.int64)
        own[by_run] = np.concatenate([x[s:s + n] for x, s, n in zip(least, (taken - ends + sizes).tolist(), count.tolist())])
        first = np.flatnonzero(shared < KEY)
        of = np.cumsum(shared < KEY) - 1
        distinct = np.frombuffer(b"".join(k.to_bytes(KEY, "big") for k in keys), np.uint8).reshape(-1, KEY)
        places = np.zeros(len(of_run), np.uint32)
        for place, earliest in enumerate(_least_by_place(distinct, shared[first], np.minimum.reduceat(own, first))):
            places |= (earliest[of] < own).astype(np.uint32) << np.uint32(place)
        result[back] = places
        np.add(taken, count, out=taken)

    order, prefix, keys = [], [], []
    for run, shared, key in merge_runs(coded, KEY):
        if shared < GRAM and len(order) >= _PART:
            settle()
            order, prefix, keys = [], [], []
        order.append(run)
        prefix.append(shared)
        if shared < KEY:
            keys.append(key)
    if order:
        settle()
    return [zlib.compress(x.tobytes(), 1) for x in np.split(result, ends[:-1])]


def removed_bytes(chunk: Chunk, buckets: int) -> np.ndarray:
    """Which bytes of the chunk go."""
    gone = np.zeros(len(chunk.raw) + 1, np.int32)
    repeated = _repeated(chunk, buckets)
    answers = {b: _split(both) for b, both in chunk.answers["answers_suffixes"].items()}
    for suffixes in _suffixes(repeated.take(~repeated.hot), buckets):
        anchors = suffixes.anchors
        places = np.concatenate([
            np.frombuffer(zlib.decompress(answers[b][0]), "<u4") for b, _, _ in split_runs(suffixes.bucket)
        ])[suffixes.of]
        places = np.where(anchors.doc > suffixes.least[suffixes.of], np.uint32((1 << PLACES) - 1), places)
        whole = places == (1 << PLACES) - 1
        np.add.at(gone, anchors.low[whole], 1)
        np.add.at(gone, anchors.high[whole] + LENGTH, -1)
        part = np.flatnonzero(~whole & (places > 0))
        for place in range(PLACES):
            start = anchors.at[part] - place
            hit = (places[part] >> np.uint32(place) & 1).astype(bool) & (start >= anchors.low[part]) & (start <= anchors.high[part])
            np.add.at(gone, start[hit], 1)
            np.add.at(gone, start[hit] + LENGTH, -1)
    strings = Strings(repeated.take(repeated.hot), buckets)
    if len(strings.high):
        earlier = np.concatenate([
            np.unpackbits(np.frombuffer(answers[b][1], np.uint8), count=e - s) for b, s, e in split_runs(strings.bucket)
        ]).astype(bool)
        for start in strings.gone(earlier):
            np.add.at(gone, start, 1)
            np.add.at(gone, start + LENGTH, -1)
    np.cumsum(gone, out=gone)
    return gone[:-1] > 0


def _results(buckets: int, texts: bool):
    def results(chunk: Chunk) -> Iterator[dict]:
        gone, raw = removed_bytes(chunk, buckets), np.frombuffer(chunk.raw, np.uint8)
        columns = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        kept_texts = []
        for end, size in zip(chunk.ends.tolist(), chunk.sizes.tolist()):
            cut = gone[end - size:end]
            n = int(np.count_nonzero(cut))
            kept = raw[end - size:end][~cut].tobytes() if n else bytes(chunk.raw[end - size:end])
            columns["n_bytes"].append(size)
            columns["n_removed"].append(n)
            columns["n_spans"].append(int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(n > 0 and cut[0]))
            columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if texts:
                kept_texts.append(kept.decode("utf-8", "ignore"))
        yield {"doc_id": chunk.ids(), **columns} | ({"text": kept_texts} if texts else {}) | chunk.carried()

    return results


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, texts: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    ``texts`` adds the remaining text; bytes of a character that was cut in half are left out of it.
    ``carry`` names columns of the documents that are handed through as in_<name>.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    chunks = stage_chunks(docs, scratch, carry, chunk_bytes)
    buckets, n_chunks = bucket_count(chunks), chunks.count()
    grams = exchange(chunks, scratch, "grams", Routes(buckets, n_chunks), _send_grams(buckets), _merge_grams)
    flagged = with_answers(chunks, grams, "answers_grams")
    suffixes = exchange(
        flagged, scratch, "suffixes", Routes(buckets, n_chunks), _send_suffixes(buckets), _merge_keys
    )
    answered = with_answers(flagged, suffixes, "answers_suffixes")
    more = "".join(f", in_{c} {docs.schema[c].dataType.simpleString()}" for c in carry or [])
    out = over_chunks(answered, _results(buckets, texts), ROWS + (", text string" if texts else "") + more)
    result = save(scratch, out, "results")
    scratch.drop("chunks", "grams", "suffixes")
    return result
