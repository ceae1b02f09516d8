"""Display details of tool calls, tool results, thinking and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import variants as V
from logloom.functions.text import LINE_BREAK, SPACE, grouped, lookup, non_empty, trim_end, trim_space

# Detail key -> label.
DETAIL_LABELS = {
    "args": "Args", "addedNames": "Added", "command": "Command", "content": "Content",
    "content.file.filePath": "File", "content.file.numLines": "Lines", "content.file.totalLines": "Total lines",
    "displayPath": "Display path", "endLine": "End line", "exitCode": "Exit code", "filename": "Filename",
    "file_path": "File", "filePath": "File", "file_text": "Content", "goal": "Goal", "hookCount": "Hook count",
    "hookInfos": "Hooks", "includePattern": "Include", "lastPrompt": "Prompt", "leafUuid": "Leaf UUID",
    "level": "Level", "lineContent": "Line match", "max_results": "Max results", "maxResults": "Max results",
    "messageCount": "Message count", "messageId": "Message ID", "mode": "Mode", "newString": "New text",
    "new_string": "New text", "newName": "New name", "oldString": "Old text", "old_string": "Old text",
    "originalFile": "Original file", "path": "Path", "paths": "Paths", "permissionMode": "Permission mode",
    "promptText": "Prompt", "query": "Query", "replace_all": "Replace all", "removedNames": "Removed",
    "scope": "Scope", "selector": "Selector", "signature": "Signature", "skillCount": "Skills",
    "sourceToolAssistantUUID": "Source assistant", "startLine": "Start line", "stderr": "Stderr",
    "stdout": "Stdout", "symbol": "Symbol", "thinking": "Thinking", "timeout": "Timeout",
    "tool_use_id": "Tool call", "toolUseId": "Tool call", "durationMs": "Duration", "url": "URL",
}
# Keys shown first, per tool and for every tool.
TOOL_PRIORITY = {
    "Bash": ["command", "goal", "mode", "timeout"],
    "Edit": ["file_path", "replace_all", "old_string", "new_string"],
    "Read": ["file_path", "startLine", "endLine"],
    "ToolSearch": ["query", "max_results"],
    "Write": ["file_path", "content"],
}
COMMON_KEYS = [
    "file_path", "filePath", "path", "paths", "command", "query", "goal", "mode", "url", "selector", "symbol",
    "newName", "scope", "includePattern", "lineContent", "args", "startLine", "endLine", "replace_all",
    "max_results", "maxResults",
]
RESULT_KEYS = [
    "type", "filePath", "path", "displayPath", "filename", "content.file.filePath", "content.file.numLines",
    "content.file.totalLines", "query", "matches", "addedNames", "removedNames", "oldString", "newString",
    "originalFile", "exitCode",
]
ATTACHMENT_KEYS = [
    "type", "displayPath", "filename", "content.file.filePath", "content.file.numLines",
    "content.file.totalLines", "skillCount", "addedNames", "removedNames",
]
EVENT_KEYS = [
    "subtype", "permissionMode", "messageId", "leafUuid", "durationMs", "messageCount", "level", "exitCode",
    "command", "hookCount", "toolUseID",
]
# Record fields that are not part of an event.
EVENT_SKIP = ("attachment", "compactMetadata", "data", "message", "microcompactMetadata", "toolUseResult")
# Keys that hold a file path, keys whose text is only counted, keys that can be previewed.
FILE_KEYS = ["file_path", "filePath", "path", "displayPath", "filename", "content.file.filePath"]
FILE_LIKE = [*FILE_KEYS, "paths"]
LARGE_TOOL_TEXT = ["code", "content", "file_text", "new_string", "old_string"]
LARGE_TEXT = [*LARGE_TOOL_TEXT, "lastPrompt", "newString", "oldString", "originalFile", "signature", "stderr", "stdout", "thinking"]
PREVIEW_KEYS = ["content", "lastPrompt", "stderr", "stdout", "text", "thinking"]
START_KEYS = ["startLine", "start_line", "lineStart", "line_start", "offset"]
TOOL_ID_KEYS = ["tool_use_id", "toolUseId"]
PREVIEW_CHARS = 50_000
INLINE, WIDE, SIGNATURE = 160, 220, 72

DETAIL = "struct<key:string,label:string,value:string>"


def key_tail(key: Column) -> Column:
    return F.coalesce(non_empty(F.element_at(F.split(key, r"\."), -1)), key)


def key_matches(key: Column, candidates: Sequence[str]) -> Column:
    return key.isin(*candidates) | key_tail(key).isin(*candidates)


def detail_lookup(details: Column, candidates: Sequence[str]) -> Column:
    """Value of the first detail whose key (or its tail) is one of ``candidates``."""
    return V.first_of(details, lambda d: key_matches(d["key"], candidates))["value"]


def detail_preferred(details: Column, candidates: Sequence[str]) -> Column:
    """Like :func:`detail_lookup` but the order of ``candidates`` decides."""
    return details_preferred(details, {"value": candidates})["value"]


def details_preferred(details: Column, wanted: dict[str, Sequence[str]]) -> Column:
    """Struct of one :func:`detail_preferred` value per entry of ``wanted``; keys and tails are taken out once for all."""

    def found(d: Column, name: str) -> Column:
        at = lambda side: F.nullif(F.array_position(d[side], F.lit(name)), F.lit(0))
        return F.get(d["values"], (F.least(at("keys"), at("tails")) - 1).cast("int"))

    parts = F.struct(
        F.transform(details, lambda d: d["key"]).alias("keys"), F.transform(details, lambda d: key_tail(d["key"])).alias("tails"),
        F.transform(details, lambda d: d["value"]).alias("values"),
    )
    return V.let(parts, lambda d: F.struct(*[F.coalesce(*[found(d, c) for c in names]).alias(n) for n, names in wanted.items()]))


def humanise(key: Column) -> Column:
    words = F.translate(F.regexp_replace(F.translate(key, ".", " "), "([a-z])([A-Z])", "$1 $2"), "_", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def truncate_inline(text: Column, width: int = INLINE) -> Column:
    def fit(line: Column) -> Column:
        cut = F.concat(trim_end(F.substring(line, 1, width - 3)), F.lit("..."))
        return F.when(F.length(line) <= width, line).otherwise(cut)

    return V.let(trim_space(F.regexp_replace(text, f"{SPACE}+", " ")), fit)


def summarise_large(text: Column) -> Column:
    lines = F.size(F.split(text, LINE_BREAK))
    return F.when(lines > 1, F.concat(grouped(lines), F.lit(" lines"))).otherwise(
        F.concat(grouped(F.length(text)), F.lit(" chars"))
    )


def format_text_detail(key: Column, clean: Column, structured: bool = False) -> Column:
    """A trimmed string value: blank as ``""``, large fields counted, the rest on one line."""
    if not structured:
        large = key.isin(*LARGE_TOOL_TEXT)
        return F.when(clean == "", '""').when(large, summarise_large(clean)).otherwise(truncate_inline(clean))
    tail = key_tail(key)
    signed = F.concat(truncate_inline(clean, SIGNATURE), F.lit(" ("), grouped(F.length(clean)), F.lit(" chars)"))
    return (
        F.when(clean == "", '""').when(tail == "signature", signed)
        .when(tail.isin(*LARGE_TEXT), summarise_large(clean)).otherwise(truncate_inline(clean, WIDE))
    )


def _number_text(value: Column) -> Column:
    """Number as text; whole values without a fraction."""
    whole = F.try_variant_get(value, "$", "double")
    return F.when(whole == F.floor(whole), F.floor(whole).cast("string")).otherwise(V.as_string(value))


def _scalar_text(value: Column) -> Column:
    return V.let(V.scalar_kind(value), lambda kind: _text_of(kind, value))


def _text_of(kind: Column, value: Column) -> Column:
    """Text of a value of a known scalar kind, NULL for other kinds."""
    return (
        F.when(kind == "STRING", trim_space(V.as_string(value))).when(kind.rlike(V.NUMBER), _number_text(value))
        .when(kind == "BOOLEAN", V.as_string(value))
    )


def _typed(key: Column, value: Column) -> Column:
    """Plain fields of a JSON value: its type, scalar text, number, element texts and field count."""
    return V.let(V.scalar_kind(value), lambda kind: _described(key, value, kind))


def _described(key: Column, value: Column, kind: Column) -> Column:
    return F.struct(
        key.alias("key"),
        F.when(V.is_null(value), "null").when(kind == "STRING", "string").when(kind.rlike(V.NUMBER), "number")
        .when(kind == "BOOLEAN", "boolean").when(V.is_array(value), "array").otherwise("object").alias("type"),
        _text_of(kind, value).alias("text"),
        F.when(kind.rlike(V.NUMBER), F.try_variant_get(value, "$", "double")).alias("number"),
        F.filter(F.transform(V.items(value), _scalar_text), lambda s: s.isNotNull() & (s != "")).alias("texts"),
        F.size(V.items(value)).alias("n_items"),
        F.size(F.map_keys(V.fields(value))).alias("n_fields"),
    )


def format_detail(typed: Column, structured: bool = False) -> Column:
    """Display text of a value described by :func:`_typed`, NULL for null."""
    key = typed["key"]
    tail = key_tail(key) if structured else key
    number = typed["text"]
    if structured:
        decimals = F.regexp_replace(F.format_number(typed["number"], 3), r"0+\z", "")
        whole = typed["number"] == F.floor(typed["number"])
        number = F.when(whole, F.format_number(typed["number"], 0)).otherwise(decimals)
        number = F.when(tail == "durationMs", F.concat(number, F.lit(" ms"))).otherwise(number)
    n = typed["n_items"]
    joined = F.when(tail.isin(*FILE_LIKE), F.array_join(typed["texts"], "\n")).otherwise(F.array_join(typed["texts"], ", "))
    fits = (F.size(typed["texts"]) == n) & (F.length(joined) <= WIDE)
    listed = F.when(n == 0, "[]").when(fits, truncate_inline(joined, WIDE)).otherwise(F.concat(grouped(n), F.lit(" items")))
    shape = F.when(typed["n_fields"] == 0, "{}").otherwise(F.concat(grouped(typed["n_fields"]), F.lit(" fields")))
    kind = typed["type"]
    return (
        F.when(kind == "string", format_text_detail(key, typed["text"], structured))
        .when(kind == "number", number).when(kind == "boolean", typed["text"])
        .when(kind == "array", listed).when(kind == "object", shape)
    )


def add_details(
    df: DataFrame, value: str, text: str, wanted: Column, top: int, structured: bool, skip: Column | None = None
) -> DataFrame:
    """Add ``details`` of the JSON value in columns ``value`` (VARIANT) and ``text``.

    Wanted keys come first in their order, then the object's own order; the first ``top`` non-empty
    values are kept. ``structured`` flattens nested objects to dotted keys. A value that is not an
    object gives a single detail. Works in steps so that no step repeats another's expression.
    """
    doc = V.Doc(F.col(value), F.col(text))
    pairs = V.flatten(doc) if structured else F.transform(
        V.entries(doc), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    )
    if skip is not None:
        pairs = F.filter(pairs, lambda p: ~F.array_contains(skip, F.substring_index(p["key"], ".", 1)))
    single = "value" if structured else "input"
    alone = F.array(F.struct(F.lit(single).alias("key"), doc.value.alias("value")))
    steps = df.withColumn("_pairs", F.when(V.is_object(doc.value), pairs).otherwise(alone))
    # Of repeated keys the last one counts: they are looked up from the end.
    steps = steps.withColumns({"_names": F.transform("_pairs", lambda p: p["key"]), "_backward": F.reverse("_pairs")})
    steps = steps.withColumn("_names_backward", F.reverse("_names"))
    known = F.array_intersect(F.concat(wanted, F.col("_names")), F.col("_names"))
    value_of = lambda k: F.get(F.col("_backward"), (F.array_position("_names_backward", k) - 1).cast("int"))["value"]
    steps = steps.withColumn("_chosen", F.transform(known, lambda k: F.struct(k.alias("key"), value_of(k).alias("value"))))
    steps = steps.withColumn("_typed", F.transform("_chosen", lambda p: _typed(p["key"], p["value"])))
    tail = lambda k: [lookup(DETAIL_LABELS, key_tail(k))] if structured else []
    label = lambda k: F.coalesce(lookup(DETAIL_LABELS, k), *tail(k), humanise(k))
    shown = F.transform(
        "_typed", lambda t: F.struct(t["key"].alias("key"), label(t["key"]).alias("label"), format_detail(t, structured).alias("value"))
    )
    kept = F.slice(F.filter(shown, lambda d: F.coalesce(d["value"], F.lit("")) != ""), 1, top)
    return steps.withColumn("details", kept).drop("_chosen", "_typed", "_names", "_names_backward", "_backward")


def tool_wanted(name: Column) -> Column:
    """Keys a tool call shows first."""
    own = F.coalesce(*[F.when(name == n, F.array(*map(F.lit, keys))) for n, keys in TOOL_PRIORITY.items()], F.array().cast("array<string>"))
    return F.concat(own, F.array(*map(F.lit, COMMON_KEYS)))


def tool_summary(name: Column, details: Column) -> Column:
    """File, else command, else query, else the first detail; reads show their line range."""
    value_of = lambda test: V.first_of(details, test)["value"]
    main = F.coalesce(
        value_of(lambda d: d["key"].isin(*FILE_LIKE)), value_of(lambda d: d["key"] == "command"),
        value_of(lambda d: d["key"] == "query"), F.get(details, F.lit(0))["value"],
    )
    start, end = value_of(lambda d: d["key"] == "startLine"), value_of(lambda d: d["key"] == "endLine")
    span = F.concat(main, F.lit(" ("), F.coalesce(start, F.lit("?")), F.lit("-"), F.coalesce(end, F.lit("?")), F.lit(")"))
    ranged = (name == "Read") & (start.isNotNull() | end.isNotNull())
    return F.when(main.isNull(), name).when(ranged, span).otherwise(main)


def clip_preview(text: Column, limit: int | None = PREVIEW_CHARS) -> Column:
    if limit is None:
        return text
    note = F.concat(trim_end(F.substring(text, 1, limit)), F.lit("\n\n[truncated "), grouped(F.length(text)), F.lit(" chars]"))
    return F.when(F.length(text) <= limit, text).otherwise(note)


def raw_preview(value: Column) -> Column:
    """First usable text of a string, array or object, uncut; NULL when there is none."""
    return V.let(value, _preview_of)


def _preview_of(value: Column) -> Column:
    part = lambda v: F.coalesce(
        F.when(V.is_string(v), trim_space(V.as_string(v))),
        trim_space(V.string_at(v, "text")), trim_space(V.string_at(v, "content")),
        V.string_at(v, "tool_name"), V.string_at(v, "toolName"), F.lit(""),
    )
    parts = F.filter(F.transform(V.items(value), part), lambda s: s != "")
    many = F.exists(parts, lambda s: F.contains(s, F.lit("\n")))
    listed = F.when(many, F.array_join(parts, "\n")).otherwise(F.array_join(parts, ", "))
    field = F.coalesce(V.string_at(value, "text"), V.string_at(value, "content"))
    return non_empty(
        F.when(V.is_string(value), trim_space(V.as_string(value))).when(V.is_array(value), listed)
        .when(V.is_object(value), trim_space(field))
    )


def text_preview(value: Column, limit: int | None = PREVIEW_CHARS) -> Column:
    """:func:`raw_preview` cut at ``limit`` characters with a note."""
    return clip_preview(raw_preview(value), limit)


def pairs_preview(pairs: Column) -> Column:
    """First flattened field that can be previewed, uncut."""
    named = F.filter(pairs, lambda p: key_tail(p["key"]).isin(*PREVIEW_KEYS))
    return V.first_of(F.transform(named, lambda p: raw_preview(p["value"])), lambda s: s.isNotNull())


def block_summary(title: Column, details: Column, content: Column) -> Column:
    """One line for a block: its content, else type and file, else the first detail, else the title."""
    file = detail_lookup(details, FILE_KEYS)
    what = detail_lookup(details, ["type", "subtype", "permissionMode", "query", "command"])
    both = F.concat(what, F.lit(": "), file)
    first = non_empty(F.get(details, F.lit(0))["value"])
    return F.coalesce(truncate_inline(non_empty(content)), both, file, what, first, title)
