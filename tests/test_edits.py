from __future__ import annotations

import pathlib
import random

from logloom.functions.linediff import diff_lines, find_lines
from logloom.operators import edits as E

EDIT = "project_id string, session_id string, path string, seq long, pos int, timestamp string, tool_name string, tool_id string, location string, old_text string, new_text string, start_line long"
SNAP = "project_id string, session_id string, path string, seq long, pos int, start_line long, content string"


def hunks(spark, edits, snapshots=()):
    rows = [("p", "s", path, i, 0, "t", "Edit", f"e{i}", None, old, new, line) for i, (path, old, new, line) in enumerate(edits)]
    seen = [("p", "s", path, seq, 0, line, content) for path, seq, line, content in snapshots]
    out = E.session_hunks(spark.createDataFrame(rows, EDIT), spark.createDataFrame(seen, SNAP)).cache()
    by = lambda kind: sorted([r for r in out.collect() if r["hunk_kind"] == kind], key=lambda r: (r["path"], r["seq"], r["hunk_no"] or 0))
    return out, by("net"), by("edit")


def test_counts_and_status(spark):
    out, _, _ = hunks(spark, [("a.ts", "one\ntwo", "one\nthree", 1), ("a.ts", "x", "x\ny", 50), ("b.ts", "k", "k\nl\nm", 3)])
    got = {r["path"]: (r["added"], r["removed"], r["edits"], r["status"]) for r in E.file_changes(out).collect()}
    assert got == {"a.ts": (2, 1, 2, "modified"), "b.ts": (2, 0, 1, "added")}
    t = E.change_totals(E.file_changes(out)).first()
    assert (t["files"], t["added"], t["removed"], t["edits"]) == (2, 4, 1, 3)


def test_patch_text(spark):
    out, net, _ = hunks(spark, [("src/app.ts", "old line", "new line", 7)])
    parts = [r["patch"] for r in E.patch_lines(out).orderBy("path", "part").collect()]
    assert "\n".join(parts) == (
        "diff --git a/src/app.ts b/src/app.ts\n--- a/src/app.ts\n+++ b/src/app.ts\n@@ -7 +7 @@ Net diff\n-old line\n+new line"
    )
    assert [r["patch"] for r in E.patch_lines(out, "edits").orderBy("part").collect()][1].startswith("@@ -7 +7 @@ Edit")


def test_edits_of_one_region_merge(spark):
    _, net, edit = hunks(spark, [("f", "alpha beta\nsecond", "alpha gamma\nsecond", 10), ("f", "alpha gamma\nsecond", "alpha delta\nsecond", 10)])
    assert len(net) == 1 and len(edit) == 2 and (net[0]["added"], net[0]["removed"]) == (1, 1)
    assert [r["text"] for r in net[0]["rows"]] == ["alpha beta", "alpha delta", "second"]


def test_an_edit_taken_back_leaves_no_net_hunk(spark):
    out, net, edit = hunks(spark, [("f", "a value", "b value", 4), ("f", "b value", "a value", 4)])
    assert net == [] and len(edit) == 2
    assert E.patch_lines(out).count() == 3  # falls back to the edits


def test_start_lines_come_from_earlier_edits_and_snapshots(spark):
    _, _, edit = hunks(
        spark,
        [("f", "unused old", "first new\nsecond new", 20), ("f", "second new", "third new", None), ("g", "limit_rows = 1;", "limit_rows = 2;", None), ("g", "}", "};", None)],
        [("g", 1, 80, " 80: line before\n 81: limit_rows = 1;\n 82: }"), ("g", 9, 500, "limit_rows = 1;")],
    )
    assert [r["old_start"] for r in edit] == [20, 21, 81, None]
    assert edit[2]["location"] == "line 81" and edit[2]["rows"][0]["old_line"] == 81
    assert edit[3]["rows"][0]["old_line"] is None


def test_lines_drift_with_earlier_edits(spark):
    grown = "seed line\n" + "\n".join(f"added {i}" for i in range(10))
    _, net, _ = hunks(spark, [("f", "seed line", grown, 5), ("f", "later value", "changed value", 25)])
    assert [(r["old_start"], r["new_start"]) for r in net] == [(5, 5), (15, 25)]


def test_overlapping_edits_make_one_hunk_with_running_numbers(spark):
    old = "\n".join(f"line {i}" for i in range(10, 16))
    new = old.replace("line 12", "line twelve")
    _, net, _ = hunks(spark, [("f", old, new, 10), ("f", "line 13\nline 14\nline 15", "line 13\nline fourteen\nline 15", 13)])
    assert len(net) == 1
    old_lines = [r["old_line"] for r in net[0]["rows"] if r["old_line"] is not None]
    assert old_lines == list(range(10, 16)) and (net[0]["added"], net[0]["removed"]) == (2, 2)


def test_files_of_many_sessions_stay_apart(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for s in range(20):
        for i in range(rng.randint(1, 5)):
            rows.append(("p", f"s{s}", "f", i, 0, "t", "Edit", "e", None, f"value {i} old", f"value {i} new", 10 * i + 1))
            want[f"s{s}"] = want.get(f"s{s}", 0) + 1
    out = E.session_hunks(spark.createDataFrame(rows, EDIT), spark.createDataFrame([], SNAP))
    got = {r["session_id"]: (r["added"], r["edits"]) for r in E.file_changes(out).collect()}
    assert got == {k: (n, n) for k, n in want.items()}


def test_diff_is_minimal_and_rebuilds_both_sides():
    rng = random.Random(7)
    for _ in range(600):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abce") for _ in range(rng.randint(0, 12))]
        rows = diff_lines(a, b)
        assert [t for k, t in rows if k != "add"] == a and [t for k, t in rows if k != "remove"] == b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert sum(k == "context" for k, _ in rows) == best[-1][-1]


def test_diff_in_linear_space_is_minimal(monkeypatch):
    from logloom.functions import linediff

    rng = random.Random(8)
    cases = [([rng.choice("abcdef") for _ in range(rng.randint(0, 40))], [rng.choice("abcdeg") for _ in range(rng.randint(0, 40))]) for _ in range(300)]
    whole = [sum(k == "context" for k, _ in diff_lines(a, b)) for a, b in cases]
    for bits, frequent in ((1, 1), (30, 3), (200, 5)):
        monkeypatch.setattr(linediff, "MOST_BITS", bits)
        monkeypatch.setattr(linediff, "FREQUENT", frequent)
        for (a, b), n in zip(cases, whole):
            rows = diff_lines(a, b)
            assert [t for k, t in rows if k != "add"] == a and [t for k, t in rows if k != "remove"] == b
            assert sum(k == "context" for k, _ in rows) == n


def test_diff_of_many_lines_needs_little_memory():
    import subprocess
    import sys

    code = """
import random, resource
from logloom.functions.linediff import diff_lines
rng = random.Random(1)
old = [f"line {i % 60000}" for i in range(200000)]
new = old[:]
for _ in range(20000):
    new[rng.randrange(len(new))] = f"line {rng.randrange(90000)}"
new = new[100:150000] + new[20:30] + new[150000:]
rows = diff_lines(old, new)
assert [t for k, t in rows if k != "add"] == old and [t for k, t in rows if k != "remove"] == new
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(pathlib.Path(__file__).resolve().parents[1]))
    assert done.returncode == 0 and int(done.stdout) < 500, (done.stdout, done.stderr[-500:])


def test_find_lines_ignores_line_numbers_on_the_second_try():
    assert find_lines(["1: a", "2: b", "b"], ["b"]) == 2
    assert find_lines(["1: a", "2: b"], ["b"]) == 1
    assert find_lines(["a"], ["a", "b"]) == -1 and find_lines(["a"], []) == 0


def test_first_block_of_the_newest_message_places_an_edit(spark):
    shown = [("f", 1, 80, "sum_of_rows = 4"), ("f", 1, 500, "sum_of_rows = 4"), ("g", 1, 10, "width_of = 2"), ("g", 2, 90, "width_of = 2")]
    rows = [("p", "s", path, seq, pos, line, text) for pos, (path, seq, line, text) in enumerate(shown)]
    edits = [("p", "s", path, 5, 0, "t", "Edit", "e", None, old, "x = 1", None) for path, old in (("f", "sum_of_rows = 4"), ("g", "width_of = 2"))]
    out = E.session_hunks(spark.createDataFrame(edits, EDIT), spark.createDataFrame(rows, SNAP)).filter("hunk_kind = 'edit'")
    assert {r["path"]: r["old_start"] for r in out.collect()} == {"f": 80, "g": 90}


def test_shifts_equal_a_walk():
    rng = random.Random(4)
    for _ in range(300):
        shifts, moves = E.LineShifts(), []
        for _ in range(rng.randrange(8)):
            at, by = rng.randrange(1, 40), rng.randrange(-6, 7)
            shifts.add(at, by)
            if by:
                moves.append((at, by))
        moves.sort(key=lambda m: m[0])
        for line in range(1, 60):
            now, then = line, line
            for at, by in moves:
                now += by if now > at else 0
            for at, by in moves[::-1]:
                then -= by if then > at else 0
            assert (shifts.forth(line), shifts.back(line)) == (max(1, now), max(1, then))


def test_many_edits_of_one_file_are_quick(spark):
    edits = [("f", f"value_{i} = old", f"value_{i} = new\nmore", 20 * i + 1) for i in range(1500)]
    _, net, _ = hunks(spark, edits)
    assert len(net) == 1500 and E.patch_lines(hunks(spark, edits[:2] + [("b", "k one", "k\nl\nm\nn two\no\np", 3)])[0]).filter("path = 'b'").first()["file_rank"] == 1


def plain_fold(edits):
    """(original line of every edit, net passages) by walking edits and passages one after the other, without any index."""
    from logloom.functions.linediff import is_distinctive, to_lines

    moves, written, passages, firsts = [], [], [], []
    for old_text, new_text, line, added in edits:
        old, new = to_lines(old_text), to_lines(new_text)
        if line is None:
            line = 1 if not old else None
            if old and is_distinctive(old):
                hits = [at + find_lines(text, old) for at, text in reversed(written) if find_lines(text, old) >= 0]
                line = hits[0] if hits else None
        first = line
        if line is not None:
            for at, by in sorted(moves, key=lambda m: m[0])[::-1]:
                first -= by if first > at else 0
            first = max(1, first)
            written.append((line, new))
        firsts.append(first)
        hit = None
        for p in passages:
            at = find_lines(p["now"], old)
            if at >= 0:
                hit = p, at
                break
            if line is None or p["line"] is None:
                continue
            if p["line"] - max(len(old), 1) <= line <= p["line"] + len(p["before"]):
                hit = (p, line - p["line"]) if p["line"] <= line <= p["line"] + len(p["now"]) else None
                break
        if hit is None:
            passages.append({"line": line, "first": first, "before": old, "now": list(new)})
        else:
            hit[0]["now"][hit[1] : hit[1] + len(old)] = new
        if line is not None and added:
            moves.append((line, added))
    out = []
    for p in passages:
        here = p["line"]
        if p["first"] is not None:
            here = p["first"]
            for at, by in sorted(moves, key=lambda m: m[0]):
                here += by if here > at else 0
            here = max(1, here)
        out.append((p["first"], here, p["before"], p["now"]))
    return firsts, out


def test_indexed_fold_equals_the_plain_one():
    rng = random.Random(12)
    words = ["alpha one", "beta two", "gamma three", "}", "", "delta four", "12: epsilon five"]
    for n in range(250):
        edits = []
        for _ in range(rng.randrange(1, 40)):
            old, new = ("\n".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(2))
            edits.append((old, new, rng.randrange(1, 120 if n % 2 else 25) if rng.random() < 0.7 else None, rng.randrange(-4, 6)))
        fold = E.FileHistory()
        for k, (old, new, line, lines) in enumerate(edits):
            fold.edit(old, new, line, lines, {"seq": k, "pos": 0, "tool_id": None, "timestamp": None})
        shifts = fold.place_edits()
        firsts, passages = plain_fold(edits)
        assert [e["original_line"] for e in fold.edits] == firsts
        got = [(p["first_edit"]["original_line"], p["line"] if p["first_edit"]["original_line"] is None else shifts.forth(p["first_edit"]["original_line"]), p["before"], p["now"]) for p in fold.passages.all]
        assert got == passages


def test_very_many_edits_of_one_file():
    import time

    rng, fold, began = random.Random(3), E.FileHistory(), time.time()
    for k in range(100_000):
        at = rng.randrange(400_000)
        fold.edit(f"value_{at} = old\n}}", f"value_{at} = new\nmore of {k}\n}}", 20 * at + 1 if k % 3 else None, 1, {"seq": k, "pos": 0, "tool_id": None, "timestamp": None})
    net = sum(1 for _ in fold.net(fold.place_edits()))
    assert net > 60_000 and time.time() - began < 120
    print("seconds", time.time() - began, net)
