"""Secret scan that links the parts of one credential.

A text is searched for three base kinds (``assign``, ``access``, ``hex``), which are always reported, and for weak parts,
which are too common to be reported alone: ``id`` (labelled account names, other key ids), ``secret`` (short or otherwise
labelled values, bare tokens of lower case, upper case and digits) and ``endpoint`` (URLs, labelled hosts). Access keys and
ids are identifiers; assigned values, hex runs and weak secrets are secrets.

Parts are linked by an interval join inside scopes. A scope is a stretch of lines without a blank line or a ``[section]``
head. Parts complement each other if they do not overlap and at most ``REACH`` code points lie between them. A weak
id needs a secret, a weak secret an identifier, an endpoint both. The join goes by strips of ``REACH`` code points: every
strip of a scope keeps the first and last place where a role begins and ends, every part asks the two strips
that its interval touches on either side, so a part costs at most four rows for each role it needs, however many parts
lie around it, and no pairs are made. Only parts are shuffled, never texts.

Weak parts that overlap base spans, or an earlier kind of weak part, are left out. Places are code points, ends exclusive.
A NULL text counts as empty; texts of any length are searched whole, in one task each; rows are told apart by a number of
their own, so rows without doc_id, with the same one, or repeated rows get a result each. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Scratch

KINDS = ["assign", "access", "hex", "id", "secret", "endpoint"]
BASE = 3  # kinds before this one are reported always
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
ROLES = [SECRET, IDENTIFIER, SECRET, IDENTIFIER, SECRET, ENDPOINT]  # by kind
NEEDS = {0: [IDENTIFIER], 1: [SECRET], 2: [IDENTIFIER], 3: [SECRET], 4: [IDENTIFIER], 5: [IDENTIFIER, SECRET]}  # by kind
REACH = 200

# The base patterns, and the least lengths of group 2, of the match, of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are taken whole, so shorter ones need not be visited
ASSIGN_LEAST, ACCESS_LEAST, SHORT_LEAST = 12, 18, 6

_TO = r"""["']?\x20*[:=]\x20*["']?"""
OTHER_IDS = re.compile(r"(?<![A-Za-z0-9])(?:ASIA|AIDA|AROA|AGPA|ANPA|ANVA)[A-Z0-9]{12,}(?![A-Za-z0-9])")
NAMED_IDS = re.compile(rf"\b(?:access_?key_?id|client_?id|account_?id|account|user_?name|user|login){_TO}([A-Za-z0-9_.@+-]{{3,}})", re.I | re.A)
URLS = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{3,}", re.I | re.A)
NAMED_HOSTS = re.compile(rf"\b(?:host_?name|host|endpoint|server){_TO}([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{{1,5}})?)", re.I | re.A)
NAMED_SECRETS = re.compile(rf"\b(?:pwd|pass|passphrase|credentials?|auth|private_?key|access_?key|key){_TO}([^\s\"']{{6,}})", re.I | re.A)
TOKENS = re.compile(r"[A-Za-z0-9+/_-]{20,}")
BREAKS = re.compile(r"\n(?=[\x20\t\r]*\n)|^\x20*\[[^\]\n]{1,80}\][\x20\t\r]*$", re.M)

SCANNED = "row bigint, doc_id bigint, spans array<struct<start:int,kind:int,end:int,scope:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _mixed(token: str) -> bool:
    return any(c.islower() for c in token) and any(c.isupper() for c in token) and any(c.isdigit() for c in token)


def _weak_matches(text: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(kind, places) of weak parts, the surer patterns first."""
    labelled = ":" in text or "=" in text
    yield 3, [m.span() for m in OTHER_IDS.finditer(text)]
    if labelled:
        yield 3, [m.span() for m in NAMED_IDS.finditer(text)]
        yield 5, [m.span() for m in URLS.finditer(text)] if "://" in text else []
        yield 5, [m.span() for m in NAMED_HOSTS.finditer(text)]
        yield 4, [m.span() for m in ASSIGN.finditer(text) if SHORT_LEAST <= m.end(2) - m.start(2) < ASSIGN_LEAST]
        yield 4, [m.span() for m in NAMED_SECRETS.finditer(text)]
    yield 4, [m.span() for m in TOKENS.finditer(text) if _mixed(m.group())]


def _free(places: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The places (start, end) that overlap none of ``taken``, which is ordered by start."""
    if not len(taken) or not len(places):
        return places
    before = np.searchsorted(taken[:, 0], places[:, 1], "left")
    reach = np.concatenate([[0], np.maximum.accumulate(taken[:, 1])])
    return places[reach[before] <= places[:, 0]]


def parts(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, scope) of base spans and weak parts, in order."""
    base = base_spans(text)
    taken = np.array([(s, e) for s, _, e in base], np.int64).reshape(-1, 2)
    found = list(base)
    for kind, places in _weak_matches(text):
        if places:
            free = _free(np.array(places, np.int64), taken)
            found += [(s, kind, e) for s, e in free.tolist()]
            taken = np.concatenate([taken, free])
            taken = taken[np.argsort(taken[:, 0], kind="stable")]
    if not found:
        return []
    found.sort()
    breaks = np.array([m.start() for m in BREAKS.finditer(text)], np.int64)
    scopes = np.searchsorted(breaks, [s for s, _, _ in found], "right").tolist()
    return [(*span, scope) for span, scope in zip(found, scopes)]


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[dict(zip(("start", "kind", "end", "scope"), p)) for p in parts(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["row", "doc_id", "spans"])


def _written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def _by_kind(kinds: dict[int, list[int] | int]) -> Column:
    return F.create_map(*[c for k, v in kinds.items() for c in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def linked_parts(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, start, kind, end, scope) of the parts that their complements stand by.

    ``found``: row, start, kind, end, scope of all parts of the rows concerned.
    """
    role = F.element_at(_by_kind(dict(enumerate(ROLES))), F.col("kind"))
    strip = lambda at: F.floor(at / reach)
    # Where a role begins counts for the parts before it, where it ends for those behind it.
    sides = F.explode(F.array(F.struct(F.lit("after").alias("side"), F.col("start").alias("at")), F.struct(F.lit("before").alias("side"), F.col("end").alias("at"))))
    met = found.select("row", "scope", role.alias("role"), sides.alias("s")).select("row", "scope", "role", "s.side", "s.at")
    strips = met.groupBy("row", "scope", "role", "side", strip(F.col("at")).alias("strip")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    asked = F.explode(F.array(
        F.struct(F.lit("after").alias("side"), F.col("end").alias("low"), (F.col("end") + reach).alias("high")),
        F.struct(F.lit("before").alias("side"), (F.col("start") - reach).alias("low"), F.col("start").alias("high")),
    ))
    part = ["row", "scope", "kind", "start", "end"]
    asks = found.select(*part, F.explode(F.element_at(_by_kind(NEEDS), F.col("kind"))).alias("role"))
    asks = asks.select(*part, "role", asked.alias("a")).select(*part, "role", "a.*")
    asks = asks.select("*", F.explode(F.sequence(strip(F.col("low")), strip(F.col("high")))).alias("strip"))
    inside = (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low"))
    hits = asks.join(strips, ["row", "scope", "role", "side", "strip"]).filter(inside)
    roles = hits.groupBy(*part).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("role"))).alias("roles"))
    needed = F.element_at(_by_kind({k: sum(1 << r for r in v) for k, v in NEEDS.items()}), F.col("kind"))
    return roles.filter(F.col("roles").bitwiseAND(needed) == needed).select("row", "start", "kind", "end", "scope")


def scan(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked and n_credentials of every document.

    ``n_linked`` counts the weak parts among the spans, ``n_credentials`` the identifiers, strong or weak, that a secret stands by.
    """
    scratch = Scratch(documents.sparkSession, "secrets")
    texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), "text")
    rows = scratch.save(texts.mapInArrow(_scan, SCANNED), "rows")
    has = lambda role: F.exists("spans", lambda s: s["kind"].isin([k for k, r in enumerate(ROLES) if r == role]))
    # Only where identifiers and secrets stand in one document can a part be linked.
    both = has(IDENTIFIER) & has(SECRET)
    found = rows.filter(both).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    span = F.struct("start", "kind", "end", "scope")
    linked = linked_parts(found, reach).groupBy("row").agg(
        F.collect_list(F.when(F.col("kind") >= BASE, span)).alias("added"),
        F.count_if(F.col("kind").isin([k for k, r in enumerate(ROLES) if r == IDENTIFIER])).alias("n_credentials"),
    )
    kinds = dict(linked.dtypes)
    alone = rows.filter(~both).withColumns({c: F.lit(None).cast(kinds[c]) for c in ("added", "n_credentials")})
    joined = alone.unionByName(rows.filter(both).join(linked, "row", "left"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    every = F.concat(base, F.coalesce("added", F.array().cast(kinds["added"])))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return joined.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(base), 256).alias("base_sha256"), _written(every).alias("spans"),
        F.coalesce(F.array_size("added"), F.lit(0)).cast("bigint").alias("n_linked"), F.coalesce("n_credentials", F.lit(0).cast("bigint")).alias("n_credentials"),
    )
