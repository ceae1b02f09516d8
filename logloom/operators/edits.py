"""File changes of a session: edits, inferred places, net hunks, summaries and patches."""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logloom.functions import linediff
from logloom.functions.details import FILE_KEYS, START_KEYS, TOOL_ID_KEYS, detail_lookup
from logloom.functions.linediff import diff_lines, find_lines, is_distinctive, plain_line, to_lines
from logloom.functions.text import edit_path, parse_line_number, trim_space

# Ship these helpers with the tasks, so executors need no copy of the package.
for _module in (linediff, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

SESSION = ["project_id", "session_id"]
# Below every line: what a node without shifts starts from.
NEVER = -(1 << 62)
# Diff rows carry how many old and new lines come before them, so numbering is an addition.
DIFF_ROWS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("old_at", T.LongType()), T.StructField("new_at", T.LongType()),
    T.StructField("text", T.StringType()),
]))
HUNK_ROW = "struct<type:string,old_line:bigint,new_line:bigint,text:string>"


def detail_path(details: Column) -> Column:
    """First non-blank line of the file detail, slashes unified."""
    value = detail_lookup(details, FILE_KEYS)
    lines = F.filter(F.transform(F.split(value, r"\r\n?|\n"), trim_space), lambda s: s != "")
    return edit_path(F.get(lines, F.lit(0)))


def detail_start(details: Column) -> Column:
    """Explicit start line of a call or block, at least 1."""
    found = F.coalesce(*[parse_line_number(detail_lookup(details, [k])) for k in START_KEYS])
    return F.when(found.isNotNull(), F.greatest(found, F.lit(1).cast("bigint")))


def session_edits(tool_calls: DataFrame) -> DataFrame:
    """Edits in order: path, old and new text, explicit start line if one is given."""
    rows = tool_calls.filter("old_text is not null").withColumns(
        {"path": detail_path(F.col("details")), "start_line": F.coalesce(detail_start(F.col("details")), parse_line_number(F.col("location")))}
    )
    return rows.filter("path is not null").select(
        *SESSION, "path", "seq", "pos", "timestamp", "tool_name", "tool_id", "location", "old_text", "new_text", "start_line"
    )


def file_snapshots(blocks: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """File contents seen in tool results; path and start come from the block or the Read call it answers."""
    reads = tool_calls.filter("tool_name = 'Read' and tool_id <> ''").select(
        *SESSION, "seq", "pos", "tool_id", detail_path(F.col("details")).alias("path"), F.coalesce(detail_start(F.col("details")), F.lit(1)).alias("start_line"),
    ).filter("path is not null")
    last = reads.groupBy(*SESSION, F.col("tool_id").alias("_id")).agg(F.max_by(F.struct("path", "start_line"), F.struct("seq", "pos")).alias("read"))
    found = blocks.filter("block_type = 'tool-result' and full_content is not null").withColumn(
        "_id", F.coalesce(detail_lookup(F.col("details"), TOOL_ID_KEYS), F.concat(F.lit("\x00"), F.col("seq").cast("string")))
    )
    joined = found.join(last, [*SESSION, "_id"], "left")
    return joined.select(
        *SESSION, F.coalesce(detail_path(F.col("details")), F.col("read.path")).alias("path"), "seq", "pos",
        F.coalesce(detail_start(F.col("details")), F.col("read.start_line"), F.lit(1)).cast("bigint").alias("start_line"),
        F.col("full_content").alias("content"),
    ).filter("path is not null")


@F.pandas_udf(DIFF_ROWS)
def _diff(old: pd.Series, new: pd.Series) -> pd.Series:
    def one(before: str, after: str) -> list[dict]:
        rows, i, j = [], 0, 0
        for kind, text in diff_lines(to_lines(before or ""), to_lines(after or "")):
            rows.append({"type": kind, "old_at": i, "new_at": j, "text": text})
            i += kind != "add"
            j += kind != "remove"
        return rows

    return pd.Series([one(a, b) for a, b in zip(old, new)])


def count_rows(rows: Column, *types: str) -> Column:
    return F.size(F.filter(rows, lambda r: r["type"].isin(*types))).cast("bigint")


def line_diff(edits: DataFrame) -> DataFrame:
    """Add ``rows`` (line diff of old and new text) and its counts; runs row by row on all tasks."""
    out = edits.withColumn("rows", _diff("old_text", "new_text"))
    return out.withColumns({"added": count_rows(F.col("rows"), "add"), "removed": count_rows(F.col("rows"), "remove")})


class LineShifts:
    """Shifts of a file's lines, from all edits of the file: shift k stands at line ``at[k]`` and moves what lies behind it.

    ``at`` and ``by`` are in the order of the edits, ``at`` is None where an edit has no place. Shifts are laid out in line
    order (equal lines by time) as the leaves of a tree and switched on one after the other. A node knows the sum of its
    shifts and the line from which on it takes them all, so undoing or doing them is a walk down the few nodes
    that a line falls into: about log(edits) steps, not one for every edit.
    """

    def __init__(self, at: list[int | None] | None = None, by: list[int] | None = None) -> None:
        self.at, self.by = at or [], by or []
        self._lay_out()

    def _lay_out(self) -> None:
        at, by = self.at, self.by
        held = sorted((line, k) for k, line in enumerate(at) if line is not None and by[k])
        self.lines = [line for line, _ in held]
        self.leaf = {k: n for n, (_, k) in enumerate(held)}
        self.size = 1
        while self.size < len(held):
            self.size *= 2
        self.sum = [0] * (2 * self.size)
        # A line above ``back`` undoes all shifts of the node, one above ``forth`` crosses them all.
        self.back_from = [NEVER] * (2 * self.size)
        self.forth_from = [NEVER] * (2 * self.size)
        # The lowest line of a node: what does not lie behind it meets none of its shifts.
        self.lowest = [NEVER] * self.size + self.lines + [-NEVER] * (self.size - len(held))
        for node in range(self.size - 1, 0, -1):
            self.lowest[node] = self.lowest[2 * node]

    def add(self, line: int | None, lines: int) -> None:
        """One more shift, all being on. The tree is laid out anew; where all edits are known, give them at once."""
        self.__init__([*self.at, line], [*self.by, lines])
        for k in range(len(self.at)):
            self.switch_on(k)

    def switch_on(self, k: int) -> None:
        """From now on the shift of edit k counts."""
        n = self.leaf.get(k)
        if n is None:
            return
        node = n + self.size
        self.sum[node] = self.by[k]
        self.back_from[node] = self.forth_from[node] = self.lines[n]
        node //= 2
        while node:
            left, right = 2 * node, 2 * node + 1
            self.sum[node] = self.sum[left] + self.sum[right]
            self.back_from[node] = max(self.back_from[right], self.back_from[left] + self.sum[right])
            self.forth_from[node] = max(self.forth_from[left], self.forth_from[right] - self.sum[left])
            node //= 2

    def back(self, line: int) -> int:
        """Where a line stood before all shifts that are on: undo them from the last one before the line on."""
        todo = [1] if self.lines else []
        while todo:
            node = todo.pop()
            if line > self.back_from[node]:
                line -= self.sum[node]
            elif node < self.size and line > self.lowest[node]:
                todo += (2 * node, 2 * node + 1)  # the right half first
        return max(1, line)

    def forth(self, line: int) -> int:
        """Where a line stands after all shifts that are on, in line order."""
        todo = [1] if self.lines else []
        while todo:
            node = todo.pop()
            if line > self.forth_from[node]:
                line += self.sum[node]
            elif node < self.size and line > self.lowest[node]:
                todo += (2 * node + 1, 2 * node)
        return max(1, line)


class SeenTexts:
    """Texts of a file by the lines in them, so that a search opens only texts that hold its rarest line."""

    def __init__(self) -> None:
        self.texts: dict[tuple, tuple[int, list[str]]] = {}
        self.holders: dict[str, set[tuple]] = {}

    def put(self, order: tuple, start: int, lines: list[str]) -> None:
        self.texts[order] = (start, lines)
        for line in {plain_line(x) for x in lines}:
            self.holders.setdefault(line, set()).add(order)

    def drop(self, order: tuple) -> None:
        for line in {plain_line(x) for x in self.texts.pop(order)[1]}:
            self.holders[line].discard(order)

    def line_of(self, wanted: list[str], before: int | None = None) -> int | None:
        """File line at which the text of highest order holds ``wanted``; ``before`` bounds the message.

        All of its lines must be in the text, so only the texts with the rarest of them are opened.
        """
        rarest = min((self.holders.get(line, set()) for line in {plain_line(x) for x in wanted}), key=len)
        for order in sorted(rarest, reverse=True):
            if before is None or order[0] < before:
                start, lines = self.texts[order]
                at = find_lines(lines, wanted)
                if at >= 0:
                    return start + at
        return None


class Passages:
    """Net effects of edits that touch each other: each has its first line, its lines before and now.

    They are found by the lines they hold now and by their first line, so an edit is held against few of them.
    """

    def __init__(self) -> None:
        self.all: list[dict] = []
        self.holders: dict[str, dict[int, int]] = {}
        self.tops: list[tuple[int, int]] = []
        self.longest = 0

    def _hold(self, number: int, lines: list[str], change: int) -> None:
        for line in lines:
            held = self.holders.setdefault(plain_line(line), {})
            held[number] = held.get(number, 0) + change
            if not held[number]:
                del held[number]

    def touched(self, line: int | None, old: list[str]) -> tuple[int | None, int]:
        """The first passage that holds the old text or whose lines the edit meets, and the place inside."""
        if not old:
            return (0, 0) if self.all else (None, 0)
        near = set(min((self.holders.get(x, {}) for x in {plain_line(x) for x in old}), key=len))
        if line is not None:
            k = bisect_left(self.tops, (line - self.longest, -1))
            while k < len(self.tops) and self.tops[k][0] <= line + max(len(old), 1):
                near.add(self.tops[k][1])
                k += 1
        for number in sorted(near):
            passage = self.all[number]
            at = find_lines(passage["now"], old)
            if at >= 0:
                return number, at
            top = passage["line"]
            if line is None or top is None:
                continue
            if top - max(len(old), 1) <= line <= top + len(passage["before"]):
                inside = top <= line <= top + len(passage["now"])
                return (number, line - top) if inside else (None, 0)
        return None, 0

    def put(self, line: int | None, old: list[str], new: list[str], edit: dict) -> None:
        number, at = self.touched(line, old)
        if number is None:
            if line is not None:
                insort(self.tops, (line, len(self.all)))
            self.longest = max(self.longest, len(old))
            self._hold(len(self.all), new, 1)
            self.all.append({"line": line, "before": old, "now": list(new), "first_edit": edit, "edit": edit})
        else:
            now = self.all[number]["now"]
            self._hold(number, now[at : at + len(old)], -1)
            now[at : at + len(old)] = new
            self._hold(number, new, 1)
            self.all[number]["edit"] = edit


class FileHistory:
    """Edits and snapshots of one file of one session, in order."""

    def __init__(self) -> None:
        self.written, self.shown = SeenTexts(), SeenTexts()
        self.last_shown: dict[tuple[int, str], tuple] = {}
        self.passages = Passages()
        self.edits: list[dict] = []

    def show(self, content: str, start: int, seq: int, pos: int) -> None:
        """Note a snapshot; a repeated one counts where it was seen last. In one message the first block leads."""
        order = (seq, -pos)
        old = self.last_shown.get((start, content))
        if old is not None:
            if old[0] == seq:
                return
            self.shown.drop(old)
        self.last_shown[start, content] = order
        self.shown.put(order, start, to_lines(content))

    def place(self, lines: list[str], seq: int) -> int | None:
        """Line of an edit that names none: where its old text was last written, else last shown."""
        if not lines:
            return 1
        if not is_distinctive(lines):
            return None
        found = self.written.line_of(lines)
        return self.shown.line_of(lines, seq) if found is None else found

    def edit(self, old_text: str, new_text: str, start_line: int | None, lines: int, kept: dict) -> None:
        """Take in an edit that makes the file longer by ``lines``; ``kept`` is what its hunks show of it."""
        old, new = to_lines(old_text), to_lines(new_text)
        line = self.place(old, kept["seq"]) if start_line is None else start_line
        if line is not None:
            self.written.put((len(self.written.texts),), line, new)
        placed = {**kept, "start_line": line, "lines": lines}
        self.passages.put(line, old, new, placed)
        self.edits.append(placed)

    def place_edits(self) -> LineShifts:
        """Give every edit its line before all earlier shifts; returns the shifts of all edits."""
        shifts = LineShifts([e["start_line"] for e in self.edits], [e["lines"] for e in self.edits])
        for k, e in enumerate(self.edits):
            e["original_line"] = None if e["start_line"] is None else shifts.back(e["start_line"])
            shifts.switch_on(k)
        return shifts

    def net(self, shifts: LineShifts) -> Iterator[dict]:
        """Net change of every passage that does not end as it began."""
        for number, p in enumerate(self.passages.all):
            first = p["first_edit"]["original_line"]
            here = p["line"] if first is None else shifts.forth(first)
            change = diff_lines(to_lines("\n".join(p["before"])), to_lines("\n".join(p["now"])))
            if any(kind != "context" for kind, _ in change):
                yield {"hunk_no": number, "old_start": first, "new_start": here, "rows": numbered(change, first, here), "last": p["edit"]}


def numbered(rows: list[tuple[str, str]], old_line: int | None, new_line: int | None) -> list[dict]:
    """Diff rows with running old and new line numbers, None where unknown."""
    out = []
    for kind, text in rows:
        out.append({
            "type": kind, "text": text, "old_line": None if kind == "add" else old_line, "new_line": None if kind == "remove" else new_line,
        })
        if kind != "add" and old_line is not None:
            old_line += 1
        if kind != "remove" and new_line is not None:
            new_line += 1
    return out


FOLD_SCHEMA = (
    "project_id string, session_id string, path string, hunk_kind string, hunk_no bigint, seq bigint, pos bigint, "
    "timestamp string, tool_name string, tool_id string, location string, old_start bigint, new_start bigint, "
    f"original_line bigint, rows array<{HUNK_ROW}>"
)


ROWS_OUT = 2048


def _hunks_of(key: tuple, fold: FileHistory) -> Iterator[dict]:
    """Rows of a file whose edits are all in: one per edit, one per net change."""
    shifts = fold.place_edits()
    named = dict(zip(("project_id", "session_id", "path"), key))
    for e in fold.edits:
        start = e["start_line"]
        yield {
            **named, "hunk_kind": "edit", "hunk_no": None, **{n: e[n] for n in ("seq", "pos", "timestamp", "tool_name", "tool_id")},
            "location": e["location"] or (None if start is None else f"line {start}"), "old_start": start, "new_start": start,
            "original_line": e["original_line"], "rows": None,
        }
    for h in fold.net(shifts):
        last, old = h["last"], h["old_start"]
        yield {
            **named, "hunk_kind": "net", "hunk_no": h["hunk_no"], **{n: last[n] for n in ("seq", "pos", "timestamp", "tool_id")}, "tool_name": "Net diff",
            "location": None if old is None else f"line {old}", "old_start": old, "new_start": h["new_start"], "original_line": old, "rows": h["rows"],
        }


def _fold_files(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Stream sorted edits and snapshots through one fold per file; only the open file is held."""
    key, fold, out = None, FileHistory(), []
    shown = ["seq", "pos", "timestamp", "tool_name", "tool_id", "location"]
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for i in range(batch.num_rows):
            here = (columns["project_id"][i], columns["session_id"][i], columns["path"][i])
            if here != key:
                for row in _hunks_of(key, fold) if key else ():
                    out.append(row)
                    if len(out) == ROWS_OUT:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                key, fold = here, FileHistory()
            content, seq, pos, start = columns["content"][i], columns["seq"][i], columns["pos"][i], columns["start_line"][i]
            if content is not None:
                fold.show(content, start, seq, pos)
            else:
                kept = {name: columns[name][i] for name in shown}
                fold.edit(columns["old_text"][i], columns["new_text"][i], start, columns["added"][i] - columns["removed"][i], kept)
    for row in _hunks_of(key, fold) if key else ():
        out.append(row)
        if len(out) == ROWS_OUT:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def session_hunks(edits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Edit hunks (one per edit, placed) and net hunks (edits of one region merged) of every file.

    The line diffs of single edits are made row by row beforehand. The rest depends on the order of
    the edits of one file, so files are hashed over tasks, sorted on the executors (spilling to disk)
    and streamed through a fold that holds the regions of one file only. Snapshots travel only where an
    edit of that file lacks a start line.
    """
    keys = [*SESSION, "path"]
    diffed = edits if "rows" in edits.columns else line_diff(edits)
    texts = ["timestamp", "tool_name", "tool_id", "location", "old_text", "new_text"]
    rows = diffed.select(*keys, "seq", F.lit(1).alias("side"), "pos", *texts, "start_line", "added", "removed", F.lit(None).cast("string").alias("content"))
    unplaced = edits.filter("start_line is null").select(*keys).distinct()
    empty = [F.lit(None).cast("string").alias(t) for t in texts]
    zero = F.lit(None).cast("bigint")
    seen = snapshots.join(unplaced, keys, "left_semi").select(
        *keys, "seq", F.lit(0).alias("side"), "pos", *empty, "start_line", zero.alias("added"), zero.alias("removed"), "content"
    )
    ordered = rows.unionByName(seen).repartition(*keys).sortWithinPartitions(*keys, "seq", "side", "pos")
    schema = to_arrow_schema(StructType.fromDDL(FOLD_SCHEMA))
    folded = ordered.mapInArrow(lambda batches: _fold_files(batches, schema), FOLD_SCHEMA)
    own = diffed.select(*keys, "seq", "pos", F.lit("edit").alias("hunk_kind"), F.col("rows").alias("edit_rows"))
    joined = folded.join(own, [*keys, "seq", "pos", "hunk_kind"], "left")
    rows_of_edit = number_rows(F.col("edit_rows"), F.col("old_start"), F.col("new_start"))
    out = joined.withColumn("rows", F.coalesce("rows", rows_of_edit)).drop("edit_rows")
    r = F.col("rows")
    return out.withColumns({
        "added": count_rows(r, "add"), "removed": count_rows(r, "remove"),
        "old_count": count_rows(r, "context", "remove"), "new_count": count_rows(r, "context", "add"),
    })


def number_rows(rows: Column, old_start: Column, new_start: Column) -> Column:
    """Line numbers for diff rows: the hunk's start plus the lines of that side before the row."""
    return F.transform(
        rows,
        lambda r: F.struct(
            r["type"].alias("type"), F.when(r["type"] != "add", old_start + r["old_at"]).alias("old_line"),
            F.when(r["type"] != "remove", new_start + r["new_at"]).alias("new_line"), r["text"].alias("text"),
        ),
    )


def change_status(added: Column, removed: Column) -> Column:
    return (
        F.when((added > 0) & (removed == 0), "added").when((removed > 0) & (added == 0), "deleted").otherwise("modified")
    )


def file_changes(hunks: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Lines added and removed (net), number of edits and status per file, most changed first."""
    net = F.col("hunk_kind") == "net"
    out = hunks.groupBy(*keys, "path").agg(
        F.coalesce(F.sum(F.when(net, F.col("added"))), F.lit(0)).alias("added"),
        F.coalesce(F.sum(F.when(net, F.col("removed"))), F.lit(0)).alias("removed"),
        F.count_if(~net).alias("edits"),
    )
    out = out.withColumn("status", change_status(F.col("added"), F.col("removed")))
    return out.orderBy(*keys, (F.col("added") + F.col("removed")).desc(), "path")


def change_totals(changes: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    return changes.groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("edits").alias("edits")
    )


def _range(start: Column, count: Column) -> Column:
    first = F.coalesce(start, F.lit(1)).cast("string")
    return F.when(count == 1, first).otherwise(F.concat_ws(",", first, count.cast("string")))


def hunk_patch(hunks: DataFrame) -> DataFrame:
    """Add ``patch``: unified text of one hunk."""
    sign = lambda r: F.when(r["type"] == "add", "+").when(r["type"] == "remove", "-").otherwise(" ")
    header = F.concat(
        F.lit("@@ -"), _range(F.col("old_start"), F.col("old_count")), F.lit(" +"), _range(F.col("new_start"), F.col("new_count")),
        F.lit(" @@ "), F.col("tool_name"),
    )
    lines = F.transform("rows", lambda r: F.concat(sign(r), r["text"]))
    return hunks.withColumn("patch", F.array_join(F.concat(F.array(header), lines), "\n"))


def patch_lines(hunks: DataFrame, mode: str = "net", keys: list[str] = SESSION) -> DataFrame:
    """Unified patch in long form, ordered by (file_rank, part): one header row and one row per hunk of a file.

    ``file_rank`` puts the files with the most changed lines first.

    Net mode falls back to the edits of a file whose net change is empty. Joined by line breaks the
    parts of a file are its patch; files are joined by blank lines.
    """
    has_net = hunks.filter("hunk_kind = 'net'").select(*keys, "path").distinct().withColumn("_net", F.lit(True))
    marked = hunks.join(has_net, [*keys, "path"], "left")
    wanted = F.lit("edit") if mode == "edits" else F.when(F.col("_net"), F.lit("net")).otherwise(F.lit("edit"))
    chosen = hunk_patch(marked.filter(F.col("hunk_kind") == wanted))
    order = F.when(F.col("hunk_kind") == "net", F.struct(F.col("hunk_no").alias("a"), F.lit(0).cast("bigint").alias("b"))).otherwise(
        F.struct(F.col("seq").alias("a"), F.col("pos").alias("b"))
    )
    body = chosen.select(*keys, "path", order.alias("part"), "patch")
    header = F.array_join(
        F.array(
            F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path"), F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path")
        ), "\n",
    )
    minus = F.lit(-1).cast("bigint")
    heads = chosen.select(*keys, "path").distinct().select(*keys, "path", F.struct(minus.alias("a"), minus.alias("b")).alias("part"), header.alias("patch"))
    churn = file_changes(hunks, keys).select(*keys, "path", (F.col("added") + F.col("removed")).alias("churn"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("churn"), "path"))
    ranks = churn.select(*keys, "path", rank.alias("file_rank"))
    return heads.unionByName(body).join(ranks, [*keys, "path"])
