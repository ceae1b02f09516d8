"""Near-duplicate groups by one-permutation hashing, banded buckets and star-shaped candidate edges.

A document's set holds its distinct 5-word shingles. Documents with 85 % common shingles are linked, and every
link is confirmed on the full sets.

1. One hash per shingle serves all 125 bins: its upper half picks the bin, its lower half competes for the
   bin's minimum. Empty bins are filled by optimal densification: bin j asks the bins h(j, 1), h(j, 2), ... and
   copies the first that is occupied. Five bins make a band; 25 bands find a pair at 85 % with a chance above
   1 - 5e-7. Documents with equal sets become one class at once, so copies never meet in a bucket.
2. A bucket yields star edges only: from its hub, the member that meets others in most bands, to the rest.
   In a group of near copies this is the common original. Pairs number at most the bucket entries.
3. After the confirmed star edges are joined to components, buckets that still hold several components are
   looked at once more: members pass by the members of other components, in blocks, and pairs that share one of the
   rarest shingles of both are confirmed on the spot. Linked sets must share one of these, so a link that runs past
   a hub is not lost, and pages of one template, which share the frequent shingles only, are not compared. Pairs inside a component, which a large group is full of, are not looked at, a pair is
   looked at in one bucket only, and no more links come out than join the components.

Sets with fewer than six shingles can only be linked when equal (5 of 6 is below 85 %) and get no signature.

Edge cases: NULL, empty and blank texts have an empty set, linked with nothing. A NULL doc_id counts as larger than
all others. Rows with one doc_id and different texts are separate members that carry one name: where it is
the smallest of two groups, these are joined. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Scratch, mix64, utf8
from logloom.llm.components import components

SHINGLE = 5
PERCENT = 85
BANDS, BAND_BINS = 25, 5
BINS = BANDS * BAND_BINS
SMALLEST = 6
BLOCK = 1024
SEEKERS = 32  # whose candidate pairs are in memory at once
LAST_ID = (1 << 63) - 1
# Ids of candidate documents up to this number are broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_EMPTY = np.uint32(0xFFFFFFFF)
_FACTORS = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
SIGNATURES = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bins binary, bands array<bigint>"


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash) of every distinct shingle, sorted."""
    split = [utf8(t).lower().split() for t in texts]  # bytes: A-Z only, ASCII white space
    counts = np.array([len(w) for w in split], np.int64)
    flat = [w for words in split for w in words]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[codes]
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    room = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), room)
    start = np.repeat(np.cumsum(counts) - counts - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
    size = np.minimum(counts[doc], SHINGLE)
    total = size.astype(np.uint64)
    for k in range(SHINGLE):
        total += np.where(k < size, padded[start + k] * _FACTORS[k], 0).astype(np.uint64)
    hashed = mix64(total)
    order = np.lexsort([hashed, doc])
    doc, hashed = doc[order], hashed[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])])
    return doc[new], hashed[new]


def signatures(doc: np.ndarray, hashed: np.ndarray, n_docs: int) -> np.ndarray:
    """Densified one-permutation signatures, a row of ``BINS`` values per document; empty sets stay empty."""
    bins = np.full((n_docs, BINS), _EMPTY, np.uint32)
    at = doc * BINS + ((hashed >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    value = np.minimum(hashed & np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFE)).astype(np.uint32)
    order = np.lexsort([value, at])
    first = np.concatenate([[True], np.diff(at[order]) > 0]) if len(at) else np.zeros(0, bool)
    bins.ravel()[at[order][first]] = value[order][first]
    source = bins.copy()
    row, column = np.nonzero((source == _EMPTY) & (source != _EMPTY).any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        ask = (mix64((column * 1_000_003 + attempt).astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
        got = source[row, ask]
        found = got != _EMPTY
        bins[row[found], column[found]] = got[found]
        row, column = row[~found], column[~found]
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band."""
    grouped = bins.reshape(len(bins), BANDS, BAND_BINS).astype(np.uint64)
    keys = np.broadcast_to(mix64(np.arange(7, 7 + BANDS, dtype=np.uint64)), grouped.shape[:2]).copy()
    for k in range(BAND_BINS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return keys.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        doc, hashed = shingle_sets(batch.column(1).to_pylist())
        sizes = np.bincount(doc, minlength=n)
        d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(d1, doc, mix64(hashed ^ np.uint64(0xA0761D6478BD642F)))
        np.add.at(d2, doc, mix64(hashed ^ np.uint64(0xE7037ED1A0B428DB)))
        large = sizes >= SMALLEST
        row_of = np.cumsum(large) - 1
        member = large[doc]
        bins = signatures(row_of[doc[member]], hashed[member], int(large.sum()))
        bands, raw = band_keys(bins), bins.astype("<u4")
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0).fill_null(LAST_ID), "n_shingles": pa.array(sizes.astype(np.int64)),
            "d1": pa.array(d1.view(np.int64)), "d2": pa.array(d2.view(np.int64)),
            "bins": pa.array([raw[r].tobytes() if x else None for r, x in zip(row_of, large)], pa.binary()),
            "bands": pa.array([bands[r] if x else None for r, x in zip(row_of, large)], pa.list_(pa.int64())),
        })


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, hashed = shingle_sets(batch.column(1).to_pylist())
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashed.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).fill_null(LAST_ID), values], names=["doc_id", "shingles"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``PERCENT`` of their union in common."""
    one = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    two = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    n = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(one, "b").join(two, "a")
        .filter(100 * n >= PERCENT * (F.size("set_a") + F.size("set_b") - n)).select("a", "b").distinct()
    )


class _Members:
    """Members of one bucket block: ids, components, signatures and full sets."""

    def __init__(self, parts: list[tuple[pa.RecordBatch, int, int]]):
        batch = pa.Table.from_batches([p.slice(low, high - low) for p, low, high in parts]).combine_chunks()
        take = lambda name: batch.column(name).to_numpy()
        self.ids, self.of, self.main = take("doc_id"), take("component"), take("main")
        self.bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), "<u4").reshape(-1, BINS)
        self.sets = [x.values.to_numpy().view(np.uint64) for x in batch.column("shingles")]
        self.sizes = np.array([len(x) for x in self.sets])
        self.values, self.member = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)

    def rarest(self, counts: np.ndarray) -> np.ndarray:
        """Places in ``values`` of every member's rarest shingles, of which a linked pair must share one.

        Linked sets have at least ``PERCENT`` of the larger one in common, so they cannot differ in all of the first
        size - PERCENT * size + 1 shingles of both, in one order of all shingles: here by count, then by value.
        """
        order = np.lexsort([self.values, counts, self.member])
        rank = np.arange(len(order)) - (np.cumsum(self.sizes) - self.sizes)[self.member[order]]
        first = self.sizes + 1 - -(-PERCENT * self.sizes // 100)
        return order[rank < first[self.member[order]]]


class _Standing(_Members):
    """Standing members with an index of their rarest shingles."""

    def __init__(self, parts: list[tuple[pa.RecordBatch, int, int]]):
        super().__init__(parts)
        self.known, inverse, self.counts = np.unique(self.values, return_inverse=True, return_counts=True)
        kept = self.rarest(self.counts[inverse])
        kept = kept[np.argsort(self.values[kept], kind="stable")]
        self.head, self.holder = self.values[kept], self.member[kept]

    def candidates(self, seek: _Members) -> Iterator[tuple[int, int]]:
        """(seeker, standing member) pairs that share one of the rarest shingles of both, by seeker."""
        at = np.minimum(np.searchsorted(self.known, seek.values), len(self.known) - 1)
        here = self.known[at] == seek.values
        kept = seek.rarest(np.where(here, self.counts[at], 0))
        kept = kept[here[kept]]
        for low in range(0, len(seek.ids), SEEKERS):
            own = kept[(seek.member[kept] >= low) & (seek.member[kept] < low + SEEKERS)]
            begin, end = (np.searchsorted(self.head, seek.values[own], side) for side in ("left", "right"))
            n = end - begin
            holder = self.holder[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            for pair in np.unique(np.repeat(seek.member[own], n) * len(self.ids) + holder).tolist():
                yield divmod(pair, len(self.ids))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ascending sets have at least ``PERCENT`` of their union in common."""
    if len(x) > len(y):
        x, y = y, x
    n = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * n >= PERCENT * (len(x) + len(y) - n)


def _meet(seek: _Members, stand: _Standing, band: int) -> Iterator[tuple[int, int]]:
    """Confirmed links of seekers with standing members, no more than join their components."""
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    for i, k in stand.candidates(seek):
        small, large = sorted((len(seek.sets[i]), len(stand.sets[k])))
        if seek.of[i] == stand.of[k] or 100 * small < PERCENT * large:
            continue
        me, other = int(seek.ids[i]), int(stand.ids[k])
        if stand.of[k] != stand.main[k] and other >= me:  # two seekers meet once
            continue
        mine, theirs = root(int(seek.of[i])), root(int(stand.of[k]))
        if mine == theirs:
            continue
        # A pair is looked at in its first common band only.
        same = (seek.bins[i] == stand.bins[k]).reshape(BANDS, BAND_BINS).all(axis=1)
        if same.argmax() == band and linked(seek.sets[i], stand.sets[k]):
            joined[mine] = theirs
            yield min(me, other), max(me, other)


def _seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket block, standing members first; these are held while seekers pass by."""
    group, parts, stand = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("band", "block", "part", "seeks")]
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        found = []
        for low, high in zip(cuts, cuts[1:]):
            here = tuple(k[low] for k in key[:3])
            if here != group:
                group, parts, stand = here, [], None
            if not key[3][low]:
                parts.append((batch, low, high))
            elif parts:
                stand = stand or _Standing(parts)
                found += _meet(_Members([(batch, low, high)]), stand, batch.column("band_no")[low].as_py())
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["a", "b"])


def second_look(entries: DataFrame, labels: DataFrame, details: DataFrame, scratch: Scratch) -> DataFrame:
    """Confirmed links between different components of one bucket.

    Members outside the bucket's most frequent component seek; they pass by all members. Both are cut into blocks, and every
    block of seekers meets every block of standing members in a group of its own.
    """
    known = entries.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    known = known.withColumn("component", F.coalesce("component", "doc_id"))
    share = known.groupBy("band", "component").agg(F.count("*").alias("n"))
    split = share.groupBy("band").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("parts")
    ).filter("parts > 1").select("band", F.col("top.component").alias("main"), "members", (F.col("members") - F.col("top.n")).alias("seekers"))
    rows = scratch.save(known.join(split, "band"), "open").join(details, "doc_id")
    blocks, parts = (F.ceil(F.col(n) / BLOCK).cast("int") for n in ("members", "seekers"))
    columns = ["band", "band_no", "block", "part", "seeks", "doc_id", "component", "main", "bins", "shingles"]
    number = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    stand = rows.withColumns({"block": number(blocks, 1), "seeks": F.lit(False)}).withColumn("part", every(parts))
    seek = rows.filter("component <> main").withColumns({"part": number(parts, 2), "seeks": F.lit(True)}).withColumn("block", every(blocks))
    place = ["band", "block", "part"]
    ordered = stand.select(columns).union(seek.select(columns)).repartition(*place).sortWithinPartitions(*place, "seeks")
    return ordered.mapInArrow(_seek, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    signed = scratch.save(texts.mapInArrow(_sign, SIGNATURES), "signed")
    same = ["n_shingles", "d1", "d2"]
    classes = (
        signed.filter("n_shingles > 0").groupBy(*same)
        .agg(F.min("doc_id").alias("name"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("bins").alias("bins"))
    )
    classes = scratch.save(classes, "classes")
    entries = classes.filter("bands IS NOT NULL").select(F.col("name").alias("doc_id"), F.posexplode("bands").alias("band_no", "band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    entries = scratch.save(entries.join(shared.select("band"), "band"), "entries")
    met = entries.groupBy("doc_id").agg(F.count("*").alias("met"))
    hubs = entries.join(met, "doc_id").groupBy("band").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("minus"))).alias("hub"))
    hubs = hubs.select("band", (-F.col("hub.minus")).alias("hub"))
    stars = entries.join(hubs, "band").filter("doc_id <> hub")
    stars = scratch.save(stars.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct(), "stars")
    needed = scratch.save(entries.select("doc_id").distinct(), "needed")
    few = needed.count() <= BROADCAST_IDS
    named = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)))
    wanted = named.join(F.broadcast(needed) if few else needed, "doc_id", "left_semi")
    sets = scratch.save(wanted.mapInArrow(_sets, "doc_id bigint, shingles array<bigint>").distinct(), "sets")
    links = scratch.save(confirm(stars, sets), "links")
    labels = components(links, scratch, "first")
    details = classes.filter("bins IS NOT NULL").select(F.col("name").alias("doc_id"), "bins").join(sets, "doc_id")
    late = scratch.save(second_look(entries, labels, details, scratch), "late")
    if not late.isEmpty():
        labels = components(links.union(late), scratch, "second")
    groups = classes.select(*same, "name").join(labels.withColumnRenamed("node", "name"), "name", "left")
    groups = groups.filter("component IS NOT NULL").unionByName(
        classes.filter("copies > 1").select(*same, "name").join(labels.select(F.col("node").alias("name")), "name", "left_anti")
        .withColumn("component", F.col("name"))
    )
    joined = signed.select("doc_id", *same).join(groups.drop("name"), same, "left")
    component = F.coalesce("component", "doc_id")
    result = joined.select(
        F.nullif(F.col("doc_id"), F.lit(LAST_ID)).alias("doc_id"), "n_shingles",
        F.nullif(component, F.lit(LAST_ID)).alias("component_id"), (F.col("doc_id") == component).alias("kept"),
    )
    result = scratch.save(result, "result")
    scratch.drop("signed", "classes", "entries", "sets", "open")
    return result


def _told_apart(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, key, copies) of the texts under a repeated or NULL doc_id; no key is a doc_id or stands twice.

    ``docs``: doc_id, text.
    """
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("often"))
    often = scratch.save(often, "often")
    few = often.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(often) if few else often, F.col("doc_id").eqNullSafe(F.col("often")), "left_semi")
    texts = rows.groupBy("doc_id", F.md5("text").alias("digest")).agg(F.count("*").alias("copies"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    key = F.lit(low or 0) - 1 - number if (low or 0) > -(1 << 62) else F.lit(high) + 1 + number
    return scratch.save(texts.withColumn("key", key), "texts")


def first_of_groups(documents: DataFrame) -> DataFrame:
    """The first document of every near-duplicate group: the smallest doc_id, NULL last, then the smallest text digest.

    Rows are told apart by doc_id and text, so repeated rows, rows that share a doc_id and rows without one are reduced
    like all others; of a text that stands several times under one doc_id the row with the smallest hash of its
    JSON form stays. Blank and NULL texts are like nothing and stay. An empty table gives none. Columns of any name
    and type are handed through: a document travels as one column.
    """
    scratch = Scratch(documents.sparkSession, "first")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), row)
    told = _told_apart(docs.select("doc_id", "text"), scratch)
    n_told = told.count()
    if not n_told:
        groups = near_duplicates(docs)
        dropped = scratch.save(groups.filter("NOT kept").select("doc_id"), "ids")
        few = dropped.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select("row.*")
    names = told.select(F.col("doc_id").alias("told_id"), "digest", "key", "copies")
    same = F.col("doc_id").eqNullSafe(F.col("told_id")) & F.md5("text").eqNullSafe(F.col("digest"))
    few = n_told <= BROADCAST_IDS // 4
    keyed = docs.join(F.broadcast(names) if few else names, same, "left").withColumn("key", F.coalesce("key", "doc_id"))
    groups = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")).filter("n_shingles > 0")
    members = groups.select(F.col("doc_id").alias("key"), "component_id").distinct().join(told, "key", "left")
    name = F.when(F.col("copies").isNull(), F.col("key")).otherwise(F.col("doc_id"))
    rank = F.struct(name.isNull().alias("no_id"), name.alias("id"), "digest", "key")
    members = scratch.save(members.select("key", "component_id", rank.alias("rank"), F.coalesce("copies", F.lit(1)).alias("copies")), "members")
    first = members.groupBy("component_id").agg(F.min("rank").alias("first"))
    judged = members.join(first, "component_id").select("key", "copies", (F.col("rank.key") == F.col("first.key")).alias("kept"))
    apart = scratch.save(judged.filter("NOT kept OR copies > 1"), "apart")
    few = apart.count() <= BROADCAST_IDS
    apart = F.broadcast(apart) if few else apart
    once = keyed.join(apart.filter("kept").select("key"), "key").groupBy("key").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return keyed.join(apart.select("key"), "key", "left_anti").select("row").unionByName(once.select("row")).select("row.*")
