"""Displayable messages of a session and, as long tables, their tool calls and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import details as D
from logloom.functions import variants as V
from logloom.functions.text import extract_command, non_blank, non_empty, trim_space
from logloom.operators.records import content, is_user, usage_columns

AT = ["project_id", "session_id", "seq"]


def _is(e: Column, name: str) -> Column:
    return F.coalesce(V.string_at(e, "type") == name, F.lit(False))


def _assistant(body: V.Doc) -> Column:
    blank = V.is_string(body.value) & (V.as_string(body.value) == "")
    return F.coalesce((F.col("type") == "assistant") & ~V.is_null(body.value) & ~blank, F.lit(False))


def _record_kind(body: V.Doc) -> Column:
    """user, command, assistant or event; NULL for records without a type."""
    text = F.when(V.is_string(body.value), V.as_string(body.value))
    command = text.rlike(r"(?s)<command-name>.*?</command-name>|<local-command-stdout>.*?</local-command-stdout>|<local-command-caveat>.*?</local-command-caveat>")
    return (
        F.when(is_user(), F.when(F.coalesce(command, F.lit(False)), "command").otherwise("user"))
        .when(_assistant(body), "assistant").when(F.col("type").isNotNull(), "event")
    )


def _shown_thinking(b: Column) -> Column:
    said = F.coalesce(trim_space(V.string_at(b, "thinking")), F.lit(""))
    signed = F.coalesce(trim_space(V.string_at(b, "signature")), F.lit(""))
    return _is(b, "thinking") & ((said != "") | (signed != ""))


def _is_call(b: Column) -> Column:
    return _is(b, "tool_use") & V.get(b, "name").isNotNull()


def message_blocks(records: DataFrame) -> DataFrame:
    """One row per block: tool results, thinking, attachments and other events of top-level files.

    The structured result of a record belongs to its first tool-result block only; without any
    block it makes one of its own.
    """
    body = V.Doc(F.col("_body"), F.get_json_object("line", "$.message.content"))
    staged = V.computed_once(
        records.filter("top_level").withColumn("_body", content().value),
        *AT, "type", "source_uuid", "tool_use_result", "attachment", "record", "line", "_body", _record_kind(body).alias("kind"),
    ).filter("kind in ('user','assistant','event')")
    empty = F.lit(None).cast("variant")
    no_text = F.lit(None).cast("string")

    def item(kind: str, block: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), block.alias("block"), text.alias("text"))

    blocks = V.elements(body)
    results = F.transform(F.filter(blocks, lambda e: _is(e["value"], "tool_result")), lambda e: item("tool-result", e["value"], e["text"]))
    bare = F.when(F.col("tool_use_result").isNotNull(), F.array(item("tool-result", empty, no_text)))
    results = V.let(results, lambda found: F.when(F.size(found) > 0, found).otherwise(bare))
    thinking = F.transform(F.filter(blocks, lambda e: _shown_thinking(e["value"])), lambda e: item("thinking", e["value"], e["text"]))
    attached = (F.col("type") == "attachment") & F.col("attachment").isNotNull()
    event = F.when(
        attached, F.array(item("attachment", F.col("attachment"), F.get_json_object("line", "$.attachment")))
    ).otherwise(F.array(item("event", F.col("record"), F.col("line"))))
    kind = F.col("kind")
    rows = staged.select(
        *AT, "type", "source_uuid", "tool_use_result", F.get_json_object("line", "$.toolUseResult").alias("result_text"),
        F.when(kind == "user", results).when(kind == "assistant", thinking).otherwise(event).alias("items"),
    ).select(*AT, "type", "source_uuid", "tool_use_result", "result_text", F.posexplode("items").alias("pos", "i"))
    rows = rows.select(*AT, "type", "source_uuid", "pos", "i.*", "tool_use_result", "result_text")

    is_result, is_event = F.col("kind") == "tool-result", F.col("kind") == "event"
    with_result = is_result & (F.col("pos") == 0) & F.col("tool_use_result").isNotNull()
    rows = rows.withColumns(
        {
            "_result": F.when(with_result, F.col("tool_use_result")),
            "_doc": F.when(with_result, F.col("tool_use_result")).when(F.col("kind") != "thinking", F.col("block")),
            "_text": F.when(with_result, F.col("result_text")).otherwise(F.col("text")),
        }
    ).drop("tool_use_result", "result_text")
    keys = lambda names: F.array(*map(F.lit, names))
    wanted = F.when(is_result, keys(D.RESULT_KEYS)).when(is_event, keys(D.EVENT_KEYS)).otherwise(keys(D.ATTACHMENT_KEYS))
    skip = F.when(is_event, keys(D.EVENT_SKIP)).otherwise(F.array().cast("array<string>"))
    rows = D.add_details(rows, "_doc", "_text", wanted, 8, True, skip)

    thought = non_empty(trim_space(V.string_at(F.col("block"), "thinking")))
    signature = non_empty(trim_space(V.string_at(F.col("block"), "signature")))
    rows = rows.withColumns({"_thought": F.when(F.col("kind") == "thinking", thought), "_signed": F.when(F.col("kind") == "thinking", signature)})

    def detail(key: str, value: Column) -> Column:
        row = F.array(F.struct(F.lit(key).alias("key"), F.lit(D.DETAIL_LABELS[key]).alias("label"), value.alias("value")))
        return F.filter(row, lambda d: d["value"].isNotNull())

    tool_id = F.when(is_result, V.string_at(F.col("block"), "tool_use_id"))
    details = F.when(
        F.col("kind") == "thinking",
        F.concat(
            detail("thinking", D.summarise_large(F.col("_thought"))),
            detail("signature", D.format_text_detail(F.lit("signature"), F.col("_signed"), True)),
        ),
    ).otherwise(F.concat(detail("tool_use_id", tool_id), F.col("details"), detail("sourceToolAssistantUUID", F.when(is_result, F.col("source_uuid")))))
    # A tool result shows its structured result, else the block's content, else the block itself.
    preview = F.coalesce(
        F.col("_thought"),
        F.when(is_result, F.coalesce(
            F.when(F.col("_result").isNotNull(), F.coalesce(D.raw_preview(F.col("_result")), D.pairs_preview(F.col("_pairs")))),
            D.raw_preview(V.get(F.col("block"), "content")),
        )),
        F.when(F.col("kind") != "thinking", F.coalesce(D.raw_preview(F.col("_doc")), D.pairs_preview(F.col("_pairs")))),
    )
    result_title = F.coalesce(D.humanise(V.string_at(F.col("_result"), "type")), F.lit("Tool Result"))
    subtype = F.coalesce(non_empty(V.string_at(F.col("block"), "subtype")), F.lit("event"))
    attachment_type = F.coalesce(V.string_at(F.col("block"), "type"), F.lit("attachment"))
    title = (
        F.when(is_result, result_title).when(F.col("kind") == "thinking", "Thinking")
        .when(F.col("kind") == "attachment", F.concat(F.lit("Attachment: "), D.humanise(attachment_type)))
        .when(F.col("type") == "system", F.concat(F.lit("System: "), D.humanise(subtype))).otherwise(D.humanise(F.col("type")))
    )
    rows = rows.withColumns({"tool_id": tool_id, "details": details, "_preview": preview, "title": title})
    summary = F.when(F.col("kind") == "thinking", F.coalesce(D.summarise_large(F.col("_thought")), F.lit(""))).otherwise(
        D.block_summary(F.col("title"), F.col("details"), F.col("_preview"))
    )
    return rows.select(
        *AT, "pos", F.when(F.col("kind") == "attachment", "event").otherwise(F.col("kind")).alias("block_type"),
        (F.col("kind") == "attachment").alias("attached"), "title", summary.alias("summary"), "details",
        D.clip_preview(F.col("_preview")).alias("content"), F.col("_preview").alias("full_content"), "tool_id",
    )


def tool_calls(records: DataFrame) -> DataFrame:
    """One row per displayed tool call of an assistant record, with its details and edit texts."""
    body = content()
    calls = F.filter(V.elements(body), lambda e: _is_call(e["value"]))
    rows = (
        records.filter(F.col("top_level") & _assistant(body))
        .select(*AT, "timestamp", F.posexplode(calls).alias("pos", "e"))
        .select(
            *AT, "timestamp", "pos", F.coalesce(V.as_string(V.get(F.col("e.value"), "name")), F.lit("")).alias("tool_name"),
            F.coalesce(V.string_at(F.col("e.value"), "id"), F.lit("")).alias("tool_id"),
            V.get(F.col("e.value"), "input").alias("input"), F.get_json_object("e.text", "$.input").alias("input_text"),
        )
    )
    rows = D.add_details(rows, "input", "input_text", D.tool_wanted(F.col("tool_name")), 6, False)
    rows = rows.withColumns({"summary": D.tool_summary(F.col("tool_name"), F.col("details")), **edit_texts("input")})
    both = F.col("old_text").isNotNull() & F.col("new_text").isNotNull()
    kept = {c: F.when(both, F.col(c)) for c in ("old_text", "new_text", "location")}
    return rows.withColumns(kept).drop("_pairs", "input", "input_text")


def edit_texts(tool: str) -> dict[str, Column]:
    """old_text, new_text and location of an edit call, NULL where blank. Never cut."""

    def text(*names: str) -> Column:
        fields = [F.when(~V.is_null(V.get(F.col(tool), n)), V.get(F.col(tool), n)) for n in names]
        return D.raw_preview(F.coalesce(*fields))

    old, new = text("old_string", "oldString"), text("new_string", "newString")
    line = V.get(F.col(tool), "startLine")
    kind = V.kind_at(F.col(tool), "startLine")
    at = F.when((kind == "STRING") | kind.rlike(V.NUMBER), F.concat(F.lit("line "), V.as_string(line)))
    return {"old_text": old, "new_text": new, "location": at}


def classify_messages(records: DataFrame) -> DataFrame:
    """One row per displayable record of the top-level files, in ``seq`` order.

    Roles: command, user, tool-result (results, no text), assistant, tool-use (calls, no text), system.
    ``tools`` lists id and name of the calls; ``result_id`` is the call a tool result answers.
    """
    body = V.Doc(F.col("_body"), F.lit(None).cast("string"))
    blocks = V.items(body.value)
    texts = F.filter(F.transform(blocks, lambda b: F.when(_is(b, "text"), V.string_at(b, "text"))), lambda s: s.isNotNull())
    plain = F.when(V.is_string(body.value), V.as_string(body.value))
    text = F.coalesce(plain, F.array_join(texts, "\n"), F.lit(""))
    calls = F.transform(
        F.filter(blocks, _is_call),
        lambda b: F.struct(F.coalesce(V.string_at(b, "id"), F.lit("")).alias("id"), V.as_string(V.get(b, "name")).alias("name")),
    )
    result_ids = F.transform(F.filter(blocks, lambda b: _is(b, "tool_result")), lambda b: V.string_at(b, "tool_use_id"))
    result_only = F.when(F.col("tool_use_result").isNotNull(), 1).otherwise(0)
    staged = V.computed_once(
        records.filter("top_level").withColumn("_body", content().value),
        *AT, "timestamp", "is_meta", "type", _record_kind(body).alias("kind"), trim_space(text).alias("text"),
        extract_command(plain).alias("command"), calls.alias("tools"), result_ids.alias("result_ids"),
        F.coalesce(F.size(F.filter(blocks, _shown_thinking)), F.lit(0)).alias("n_thinking"), result_only.alias("bare"),
        F.coalesce(F.exists(blocks, lambda b: _is(b, "thinking") & non_blank(V.string_at(b, "thinking"))), F.lit(False)).alias("thought"),
        V.string_at(F.col("message"), "id").alias("message_id"), V.string_at(F.col("message"), "model").alias("model"),
        V.string_at(F.col("message"), "stop_reason").alias("stop_reason"), *usage_columns(),
    )
    kind, text = F.col("kind"), F.col("text")
    n_calls = F.greatest(F.coalesce(F.size("tools"), F.lit(0)), F.lit(0))
    n_results = F.greatest(F.coalesce(F.size("result_ids"), F.lit(0)), F.col("bare"))
    role = (
        F.when(kind == "command", "command")
        .when((kind == "user") & (text != ""), "user").when((kind == "user") & (n_results > 0), "tool-result")
        .when((kind == "assistant") & (text == "") & (n_calls > 0), "tool-use")
        .when((kind == "assistant") & ((text != "") | (F.col("n_thinking") > 0)), "assistant")
        .when(kind == "event", "system")
    )
    said = F.when(kind == "command", F.col("command.content")).when(kind == "event", F.lit("")).otherwise(text)
    meta = F.coalesce("is_meta", F.lit(False)) | F.coalesce("command.is_meta", F.lit(False))
    own = ["message_id", "model", "stop_reason", "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens",
           "cache_5m_tokens", "cache_1h_tokens", "service_tier", "tools"]
    out = staged.withColumn("role", role).filter("role is not null")
    return out.select(
        *AT, "role", F.coalesce(said, F.lit("")).alias("content"), "timestamp", meta.alias("is_meta"),
        F.when(kind == "assistant", F.col("has_usage")).otherwise(F.lit(False)).alias("has_usage"),
        *[F.when(kind == "assistant", F.col(c)).alias(c) for c in own],
        F.when(F.col("role") == "tool-result", V.first_of(F.col("result_ids"), lambda s: s.isNotNull())).alias("result_id"),
        F.when(kind == "assistant", F.col("thought")).otherwise(F.lit(False)).alias("has_thinking"),
    )
