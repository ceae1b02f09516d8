"""Line helpers used inside Arrow tasks: minimal line diff and search for a block of lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

# A line number as file viewers print it, and lines of brackets only.
NUMBERED = re.compile(r"^\s*\d+\s*(?::|\||\s{2,})\s?")
BRACKETS = re.compile(r"^[{}()\[\];,]+$")


def to_lines(text: str) -> list[str]:
    """Lines of a text; escaped line breaks count as real ones, an empty text has none."""
    plain = text.replace("\\r\\n", "\n").replace("\\n", "\n").replace("\r\n", "\n").replace("\r", "\n")
    return plain.split("\n") if plain else []


def plain_line(line: str) -> str:
    """Line as it stands in the file, without a viewer's line number."""
    return NUMBERED.sub("", line, count=1)


def _offset(text: list[str], part: list[str]) -> int:
    """Index of ``part`` in ``text`` by one substring search over lines framed by line breaks; -1 if absent."""
    joined = "\n" + "\n".join(text) + "\n"
    found = joined.find("\n" + "\n".join(part) + "\n")
    return found if found < 0 else joined.count("\n", 0, found)


def find_lines(text: list[str], part: list[str]) -> int:
    """First index at which ``part`` stands in ``text``, line numbers included or else left out; -1 if absent."""
    if not part or len(part) > len(text):
        return -1 if part else 0
    exact = _offset(text, part)
    return exact if exact >= 0 else _offset([plain_line(x) for x in text], [plain_line(x) for x in part])


def is_distinctive(lines: list[str]) -> bool:
    """Whether finding these lines says anything: two lines that are not blank, or one with a word in it."""
    said = [x for x in (plain_line(line).strip() for line in lines) if x]
    return len(said) > 1 or any(len(x) > 2 and BRACKETS.match(x) is None for x in said)


# Bits of match history that are kept at once; larger problems are cut in two.
MOST_BITS = 1 << 29
# Lines that stand this often keep their bits; those of others are made when needed, so bits do not grow with the square.
FREQUENT = 256


def _bits(places: list[int]) -> int:
    if len(places) < 4:
        return sum(1 << p for p in places)
    flags = np.zeros(places[-1] + 1, np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After every line of ``a``: an integer whose zero bits mark where the common subsequence with ``b`` grows."""
    places: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    small = len(a) * len(b) <= MOST_BITS
    kept = {y: _bits(p) for y, p in places.items() if small or len(p) >= FREQUENT}
    full = state = (1 << len(b)) - 1
    for x in a:
        bits = kept.get(x)
        hit = state & (_bits(places[x]) if bits is None else bits)
        state = ((state + hit) | (state - hit)) & full
        yield state


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    state = (1 << len(b)) - 1
    for state in _rows(a, b):
        pass
    raw = np.frombuffer(state.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    zeros = 1 - np.unpackbits(raw, bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(zeros)])


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in linear space.

    A problem whose history fits is traced back. Otherwise ``a`` is halved and ``b`` cut where the lengths
    of both sides add up to the most.
    """
    if len(a) * len(b) > MOST_BITS and len(a) > 1:
        half = len(a) // 2
        here = set(a[:half]) & set(b)
        there = set(a[half:]) & set(b)
        score = _lengths([x for x in a[:half] if x in here], b) + _lengths([x for x in reversed(a[half:]) if x in there], b[::-1])[::-1]
        cut = int(score.argmax())
        return _matched(a[:half], b[:cut], 0, 0) + _matched(a[half:], b[cut:], half, cut)
    history = list(_rows(a, b))
    kept: list[tuple[int, int]] = []
    r, c = len(a), len(b)
    while r and c:
        if history[r - 1] >> (c - 1) & 1:
            c -= 1
            continue
        r -= 1
        if r and not history[r - 1] >> (c - 1) & 1:
            continue
        c -= 1
        kept.append((r, c))
    return kept[::-1]


def _matched(a: list[int], b: list[int], rows: int, columns: int) -> list[tuple[int, int]]:
    """:func:`_common` over the lines that both sides have, with places moved on."""
    both = set(a) & set(b)
    own = [i for i, x in enumerate(a) if x in both]
    other = [j for j, y in enumerate(b) if y in both]
    return [(own[i] + rows, other[j] + columns) for i, j in _common([a[i] for i in own], [b[j] for j in other])]


def diff_lines(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Minimal line diff as (context | remove | add, line); removals come before additions.

    Longest common subsequence in linear space, with one big integer of match bits per old line, after common ends
    and lines that occur on one side only are set aside.
    """
    head = 0
    while head < len(old) and head < len(new) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < len(old) - head and tail < len(new) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    codes: dict[str, int] = {}
    numbers = [[codes.setdefault(x, len(codes)) for x in side] for side in (a, b)]
    kept = _matched(*numbers, 0, 0)
    out = [("context", x) for x in old[:head]]
    i = j = 0
    for x, y in [*kept, (len(a), len(b))]:
        out += [("remove", s) for s in a[i:x]] + [("add", s) for s in b[j:y]]
        if x < len(a):
            out.append(("context", a[x]))
        i, j = x + 1, y + 1
    return out + [("context", s) for s in (old[len(old) - tail :] if tail else [])]
