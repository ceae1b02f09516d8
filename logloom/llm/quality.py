"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Every line is described by shares of character classes, lengths, and whether it or its words repeat. The field adds
weights for a line's features and for the step from one line's label to the next; Viterbi decoding gives the best
labels of all lines of a text together. A text is kept if content lines hold at least half of its words and it
does not fail the base rules (under 20 words, or over 30 % of the words inside repeated 8-word windows).

The field is fitted on the labelled documents: lines of good ones count as content, of bad ones as boilerplate. The
fit takes at most ``SAMPLE_DOCS`` documents per label, those with the smallest hash of their id; only their line
features reach the driver. Without documents of both labels nothing is boilerplate.

All counts run over whole texts, a batch of texts at a time, in numpy on their bytes.

Edge cases: a NULL text has no words and fails the base rules; repeated rows are judged alike; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import ROWS_PER_BATCH, mix64, utf8

SAMPLE_DOCS = 600
CONTENT_SHARE = 0.5
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
STEPS, RATE, RIDGE = 120, 0.15, 1e-3
ROWS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_words bigint"
# The symbols that the base rules count, and ASCII white space.
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_FACTORS = mix64(np.arange(301, 301 + WINDOW, dtype=np.uint64)) | np.uint64(1)
_SHARE_CUTS = np.array([0.005, 0.02, 0.05, 0.12, 0.3, 0.6])
_LENGTH_CUTS = np.array([1, 3, 6, 12, 25, 60])


def _class(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(c) for c in range(256)])


_CLASSES = {
    "upper": _class(lambda c: 65 <= c <= 90), "digit": _class(lambda c: 48 <= c <= 57), "mark": _class(lambda c: c in b"!?"),
    "symbol": _class(lambda c: c in SYMBOLS), "stop": _class(lambda c: c in b".,;:"),
    "other": _class(lambda c: 33 <= c < 127 and not chr(c).isalnum() and c not in b"!?.,;:" + SYMBOLS),
    "wide": _class(lambda c: c >= 128), "char": _class(lambda c: c not in SPACE and not 128 <= c < 192), "space": _class(lambda c: c in SPACE),
}
N_FEATURES = 1 + (len(_CLASSES) - 1) * len(_SHARE_CUTS) + 2 * len(_LENGTH_CUTS) + 2


def _sums(raw: np.ndarray, flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bytes of a class in each stretch between neighbouring cuts."""
    return np.diff(np.concatenate([[0], np.cumsum(flags[raw])])[cuts])


class Batch:
    """Counts and line features of a batch of texts."""

    def __init__(self, texts: list[str | None]):
        raws = [utf8(t) for t in texts]
        lines = [r.split(b"\n") for r in raws]
        self.n_lines = np.array([len(x) for x in lines])
        flat = [line for x in lines for line in x]
        sizes = np.array([len(x) for x in flat], np.int64)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        joined = np.frombuffer(b"".join(flat), np.uint8)
        counts = {name: _sums(joined, flags, cuts) for name, flags in _CLASSES.items()}
        words = [line.split() for line in flat]
        self.line_words = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(self.n_lines)
        over = lambda per_line: np.diff(np.concatenate([[0], np.cumsum(per_line)])[np.concatenate([[0], ends])])
        self.n_words, self.word_chars, self.n_symbols = over(self.line_words), over(counts["char"]), over(counts["symbol"])
        again = np.zeros(len(flat), bool)
        at = 0
        for x in lines:
            seen = set()
            for i, line in enumerate(x, at):
                if self.line_words[i]:
                    again[i] = line in seen
                    seen.add(line)
            at += len(x)
        self.n_dup_lines = over(again)
        self.repeat = self._repeated([w for line in words for w in line])
        self.n_repeat_words = np.diff(np.concatenate([[0], np.cumsum(self.repeat)])[np.concatenate([[0], np.cumsum(self.n_words)])])
        word_cuts = np.concatenate([[0], np.cumsum(self.line_words)])
        repeats = np.diff(np.concatenate([[0], np.cumsum(self.repeat)])[word_cuts])
        visible = np.maximum(sizes - counts["space"], 1)
        columns = [np.ones((len(flat), 1), bool)]
        columns += [(counts[n] / visible)[:, None] > _SHARE_CUTS for n in _CLASSES if n not in ("char", "space")]
        columns += [(repeats / np.maximum(self.line_words, 1))[:, None] > _SHARE_CUTS]
        columns += [self.line_words[:, None] >= _LENGTH_CUTS, (visible / np.maximum(self.line_words, 1))[:, None] >= _LENGTH_CUTS]
        columns += [again[:, None], (self.line_words == 0)[:, None]]
        self.features = np.hstack(columns)

    def _repeated(self, words: list[bytes]) -> np.ndarray:
        """Which words stand in an 8-word window that occurs twice in its text."""
        out = np.zeros(len(words), bool)
        room = np.maximum(self.n_words - WINDOW + 1, 0)
        if not room.sum():
            return out
        codes, distinct = pd.factorize(np.array(words, dtype=object))
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[codes]
        start = np.repeat(np.cumsum(self.n_words) - self.n_words - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
        total = np.zeros(len(hashes) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            total += hashes[k:k + len(total)] * _FACTORS[k]
        text = np.repeat(np.arange(len(room)), room)
        key = mix64(mix64(total)[start] + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        ranked = key[order]
        edge = np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])
        twice = start[order[~(edge[:-1] & edge[1:])]]
        cover = np.zeros(len(words) + 1, np.int32)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        return np.cumsum(cover[:-1]) > 0


class LineField:
    """A linear-chain conditional random field with the labels boilerplate (0) and content (1)."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    @classmethod
    def fit(cls, texts: list[np.ndarray], labels: list[int]) -> LineField:
        """Maximise the conditional likelihood of the line labels by gradient ascent with momentum terms."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order])
        x = np.concatenate([texts[i] for i in order]).astype(np.float64)
        y = np.array([labels[i] for i in order])
        begin = np.cumsum(lengths) - lengths
        alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths.max()))]
        share = np.bincount(np.repeat(y, lengths), minlength=2) / lengths.sum()
        balance = 0.5 / np.maximum(share, 1e-9)  # both labels weigh alike
        w, steps = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
        mean = [np.zeros_like(w), np.zeros_like(steps)]
        square = [np.zeros_like(w), np.zeros_like(steps)]
        heavy = balance[y]
        for n in range(1, STEPS + 1):
            score = x @ w
            scale = np.exp(score - score.max(axis=1, keepdims=True))
            move = np.exp(steps)
            forward, backward = np.empty_like(scale), np.ones_like(scale)
            for t, k in enumerate(alive):
                at = begin[:k] + t
                into = scale[at] * (forward[at - 1] @ move if t else 1.0)
                forward[at] = into / into.sum(axis=1, keepdims=True)
            pair = np.zeros((2, 2))
            for t in range(len(alive) - 1, 0, -1):
                at = begin[:alive[t]] + t
                ahead = scale[at] * backward[at]
                both = forward[at - 1][:, :, None] * move * ahead[:, None, :]
                both /= both.sum(axis=(1, 2), keepdims=True)
                pair += (both * heavy[:alive[t], None, None]).sum(axis=0)
                back = ahead @ move.T
                backward[at - 1] = back / back.sum(axis=1, keepdims=True)
            chance = forward * backward
            chance /= chance.sum(axis=1, keepdims=True)
            truth = np.zeros_like(chance)
            truth[np.arange(len(x)), np.repeat(y, lengths)] = 1
            seen = np.diag(np.bincount(y, (lengths - 1) * heavy, minlength=2))
            grads = [x.T @ ((truth - chance) * np.repeat(heavy, lengths)[:, None]) / len(x) - RIDGE * w, (seen - pair) / len(x) - RIDGE * steps]
            for value, grad, m, s in zip((w, steps), grads, mean, square):
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                value += RATE * (m / (1 - 0.9 ** n)) / (np.sqrt(s / (1 - 0.99 ** n)) + 1e-8)
        return cls(w, steps)

    def decode(self, features: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Viterbi labels of the lines of all texts."""
        score = (features.astype(np.float32) @ self.weights).tolist()
        (stay0, to1), (to0, stay1) = self.steps.tolist()
        labels = np.zeros(len(score), bool)
        at = 0
        for n in n_lines.tolist():
            a, b = score[at]
            back = []
            for e0, e1 in score[at + 1:at + n]:
                x0, x1 = a + stay0, b + to0
                y0, y1 = a + to1, b + stay1
                back.append((x1 > x0, y1 > y0))
                a, b = max(x0, x1) + e0, max(y0, y1) + e1
            label = b >= a
            labels[at + n - 1] = label
            for i in range(n - 2, -1, -1):
                label = back[i][label]
                labels[at + i] = label
            at += n
        return labels


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = Batch(batch.column(1).to_pylist())
        parts = np.split(np.packbits(b.features, axis=1), np.cumsum(b.n_lines)[:-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([p.tobytes() for p in parts], pa.binary())], names=["label", "features"]
        )


def fit_field(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LineField | None:
    """Fit on a bounded sample of labelled documents, each with all of its lines."""
    chosen = [
        labels.filter(F.col("quality") == q).select("doc_id", F.lit(q).alias("label")).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for q in (0, 1)
    ]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample_docs rows
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(picked, "doc_id").select("label", "text")
    rows = sorted(map(tuple, texts.mapInArrow(_describe, "label int, features binary").collect()))
    if len({label for label, _ in rows}) < 2:
        return None
    width = -(-N_FEATURES // 8)
    unpack = lambda raw: np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, width), axis=1, count=N_FEATURES)
    return LineField.fit([unpack(bytes(f)) for _, f in rows], [label for label, _ in rows])


def _judge(field: LineField | None):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (big.slice(at, ROWS_PER_BATCH) for big in batches for at in range(0, big.num_rows, ROWS_PER_BATCH)):
            b = Batch(batch.column(1).to_pylist())
            content = field.decode(b.features, b.n_lines) if field else np.ones(len(b.features), bool)
            ends = np.concatenate([[0], np.cumsum(b.n_lines)])
            words = np.diff(np.concatenate([[0], np.cumsum(b.line_words * content)])[ends])
            failed = (b.n_words < LEAST_WORDS) | (100 * b.n_repeat_words > MOST_REPEATED_PERCENT * b.n_words)
            kept = ~failed & (words >= CONTENT_SHARE * b.n_words)
            values = [b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, failed, kept, words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v if v.dtype == bool else v.astype(np.int64)) for v in values], *batch.columns[2:]],
                names=[c.split()[0] for c in ROWS.split(", ")] + batch.schema.names[2:],
            )

    return judge


def judge(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Counts and verdict of every document; ``carry`` names columns handed through beside them as in_<name>.

    The result is a single pass over the texts and is not written in between.
    """
    field = fit_field(docs, labels)
    carry = carry or []
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *[F.col(c).alias(f"in_{c}") for c in carry])
    more = "".join(f", in_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return texts.mapInArrow(_judge(field), ROWS + more)
