"""Queries over JSON log lines that Spark makes from the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import context as C
from logloom.operators import edits as E
from logloom.operators import files as FI
from logloom.operators import messages as M
from logloom.operators import records as R
from logloom.operators import sessions as S
from logloom.operators import transcript as T
from logloom.operators.pricing import MICRO, costs_rounded
from logloom.operators.scans import chunk_of
from logloom.plans import sqlparts as q
from logloom.plans.edit_sql import edit_answers
from logloom.plans.flow_queries import FLOW, PAIRS
from logloom.plans.session_logs import summarise_logs
from logloom.session import cut_lineage
from logloom.sources import logs, tables as t
from logloom.sources.prices import default_prices, normalise_prices

SESSION = ["project_id", "session_id"]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_envelope(logs.with_path_dims(t.log_lines(spark, d)))


def _pack(details: Column) -> Column:
    return F.array_join(F.transform(details, lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|")


def record_types(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d)
    return rows.groupBy(*SESSION, "type").agg(F.count("*").alias("records"), F.min("timestamp").alias("first_at"), F.max("seq").alias("last_seq"))


def content_blocks(spark: SparkSession, d: str) -> DataFrame:
    return R.explode_blocks(_records(spark, d)).groupBy("session_id", "type", "block_type", "pos").agg(F.count("*").alias("blocks"))


def session_messages(spark: SparkSession, d: str) -> DataFrame:
    m = M.classify_messages(_records(spark, d))
    tools = F.array_join(F.transform("tools", lambda x: F.concat(x["name"], F.lit(":"), x["id"])), ",")
    return m.select("session_id", "seq", "role", "content", "is_meta", "result_id", F.coalesce(tools, F.lit("")).alias("tool_list"), "input_tokens", "has_thinking")


def tool_call_details(spark: SparkSession, d: str) -> DataFrame:
    calls = M.tool_calls(_records(spark, d))
    return calls.select("session_id", "seq", "tool_name", "tool_id", "summary", _pack(F.col("details")).alias("details"))


def edit_texts(spark: SparkSession, d: str) -> DataFrame:
    calls = M.tool_calls(_records(spark, d)).filter("old_text is not null")
    return calls.select("session_id", "seq", "old_text", "new_text", "location")


def message_block_details(spark: SparkSession, d: str) -> DataFrame:
    blocks = M.message_blocks(_records(spark, d))
    return blocks.select("session_id", "seq", "pos", "block_type", "attached", "title", "summary", _pack(F.col("details")).alias("details"), "content", "tool_id")


def compaction_log(spark: SparkSession, d: str) -> DataFrame:
    return R.compaction_events(_records(spark, d)).select("session_id", "seq", "timestamp", "is_compaction", "is_microcompaction", "trigger", "pre_tokens", "tokens_saved")


def log_session_summary(spark: SparkSession, d: str) -> DataFrame:
    """From JSON lines to session totals: parse, collapse turns, count, price."""
    out = summarise_logs(_records(spark, d), default_prices(spark))
    keep = ["session_id", "user_count", "assistant_count", "message_count", "tool_count", "compactions", "cwd", "input_tokens",
            "output_tokens", "cache_write_tokens", "cache_read_tokens"]
    return out.select(*keep, *costs_rounded()).drop(*MICRO)


def log_search(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    span = S.session_span(R.record_facts(records)).select(*SESSION, "started_at")
    return S.search_sessions(R.search_texts(records), span, "SEEN 12", None)


def prompt_contributions(spark: SparkSession, d: str) -> DataFrame:
    return C.prompt_contributions(_records(spark, d)).select("session_id", "seq", "type", *C.BUCKETS, "hidden_thinking")


def context_before_replies(spark: SparkSession, d: str) -> DataFrame:
    """Contributions, running context and reconciliation of every assistant record."""
    given = C.prompt_contributions(_records(spark, d)).drop("file_path", "top_level", "timestamp", "output_tokens")
    ctx = C.running_context(given, SESSION, "seq", chunk_of(F.col("seq"), 1 << 20), F.col("type") == "assistant", [*C.BUCKETS, "hidden_thinking"])
    out = C.prompt_breakdown(ctx.filter("type = 'assistant'"))
    return out.select("session_id", "seq", *[f"{b}_tokens" for b in C.BUCKETS], "total_tokens", "overflow")


def _mentions_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Read calls and all blocks, with what :func:`files.file_mentions` reads of them: the rest is not computed."""
    records = _records(spark, d)
    calls = M.tool_calls(records).filter("tool_name = 'Read'").select(*M.AT, "pos", "tool_name", "tool_id", "details")
    return cut_lineage(calls), M.message_blocks(records).select(*M.AT, "pos", "details", "attached", "content")


def file_mentions(spark: SparkSession, d: str) -> DataFrame:
    return FI.file_mentions(*_mentions_input(spark, d)).drop("kind_order")


def context_files(spark: SparkSession, d: str) -> DataFrame:
    return FI.context_files(cut_lineage(FI.file_mentions(*_mentions_input(spark, d))))


def context_file_coverage(spark: SparkSession, d: str) -> DataFrame:
    mentions = cut_lineage(FI.file_mentions(*_mentions_input(spark, d)))
    files = cut_lineage(FI.context_files(mentions))
    return FI.context_coverage(mentions, files)


def context_file_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every message that mentions a file, numbered by file."""
    mentions = cut_lineage(FI.file_mentions(*_mentions_input(spark, d)))
    return FI.mention_places(mentions, cut_lineage(FI.context_files(mentions)))


def counted_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Contributions with a Python counter over distinct, normalised texts; plain ASCII counts as with the default one."""
    return C.counted_contributions(_records(spark, d)).select("session_id", "seq", "type", *C.BUCKETS, "hidden_thinking")


def log_tool_pairs(spark: SparkSession, d: str) -> DataFrame:
    grouped = cut_lineage(T.assign_groups(M.classify_messages(_records(spark, d)), SESSION))
    return T.pair_tools(grouped, SESSION).drop("project_id", "use_at", "result_at", "pos")


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    calls = cut_lineage(M.tool_calls(records).drop("summary"))
    results = M.message_blocks(records).filter("block_type = 'tool-result'")
    blocks = cut_lineage(results.select(*M.AT, "pos", "block_type", "details", "full_content"))
    diffed = cut_lineage(E.line_diff(E.session_edits(calls)))
    return E.session_hunks(diffed, E.file_snapshots(blocks, calls))


def session_hunks(spark: SparkSession, d: str) -> DataFrame:
    sign = F.transform("rows", lambda r: F.concat(F.when(r["type"] == "add", "+").when(r["type"] == "remove", "-").otherwise(" "), r["text"]))
    return _hunks(spark, d).withColumn("rows", F.array_join(sign, "|"))


def edit_line_diffs(spark: SparkSession, d: str) -> DataFrame:
    calls = M.tool_calls(_records(spark, d))
    out = E.line_diff(E.session_edits(calls))
    return out.select("session_id", "seq", "path", "added", "removed", "start_line")


def file_change_list(spark: SparkSession, d: str) -> DataFrame:
    return E.file_changes(cut_lineage(_hunks(spark, d)))


def session_patches(spark: SparkSession, d: str) -> DataFrame:
    return E.patch_lines(cut_lineage(_hunks(spark, d))).select("session_id", "path", F.col("part.a").alias("part"), F.col("part.b").alias("subpart"), "patch")


def price_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """A vendor registry with one entry per part."""
    name = F.expr("""concat(element_at(array('claude-', 'gpt-', 'o3-', 'ft:gpt-', 'azure/gpt-', 'gpt-image-', 'text-'), cast(p_partkey % 7 + 1 as int)), p_partkey)""")
    entry = F.expr("""to_json(named_struct('litellm_provider', if(p_partkey % 7 = 0, 'anthropic', 'openai'),
        'input_cost_per_token', if(p_size % 11 = 0, null, p_size / 1000000D), 'output_cost_per_token', p_size / 250000D,
        'cache_read_input_token_cost', if(p_size % 2 = 0, p_size / 10000000D, null)))""")
    registry = t.load(spark, d, "part").select(name.alias("model"), F.parse_json(entry).alias("entry"))
    out = normalise_prices(registry)
    return out.select("model", "provider", *[F.col(c).cast("double").alias(c) for c in out.columns[2:]])


def prompt_history(spark: SparkSession, d: str) -> DataFrame:
    ev = t.events_base(spark, d)
    line = F.expr("""if(event_id % 50 = 3, '{broken', to_json(named_struct('display', concat('ask ', event_id), 'project', project_id,
        'timestamp', unix_millis(cast(ts as timestamp)), 'pastedContents', named_struct('n', k))))""")
    rows = logs.parse_history(ev.select(line.alias("value")))
    return rows.select("display", "project", F.date_format("at", "yyyy-MM-dd HH:mm").alias("minute"), F.expr("try_variant_get(pasted, '$.n', 'bigint')").alias("pasted"))


QUERIES = {
    f.__name__: f
    for f in (
        record_types, content_blocks, session_messages, tool_call_details, edit_texts, message_block_details, compaction_log,
        log_session_summary, log_search, prompt_contributions, context_before_replies, file_mentions, context_files,
        context_file_coverage, context_file_messages, counted_contributions, log_tool_pairs, session_hunks, edit_line_diffs, file_change_list, session_patches,
        price_normalisation, prompt_history,
    )
}

LINES = """lines as (select *, 'u'||user_id sid, '-home-p'||(user_id % 5) pid, 'src/f'||(k % 10)||'.ts' path from ev where event_id % 97 not in (5, 6, 7)),
edits as (select *, 'line '||(k % 12)||chr(10)||'keep '||(k % 5) old_text, 'line '||(k % 12 + 4)||chr(10)||'keep '||(k % 5)||chr(10)||'added' new_text from lines where event_type = 'click' and k % 4 = 1)"""
IDS = "sid session_id, event_id seq"
RESULT_TEXT = "'line '||(k % 12)||chr(10)||'keep '||(k % 5)"

ORACLE = {
    "record_types": q.with_(["ev"], """select pid project_id, sid session_id, "type", count(*) records, min(tstamp) first_at, max(event_id) last_seq from (
      select *, case event_type when 'click' then 'assistant' when 'view' then 'assistant' when 'purchase' then 'user' when 'signup' then 'user' else case when k % 2 = 0 then 'attachment' else 'system' end end as "type" from lines) group by all""", LINES),
    "content_blocks": q.with_(["ev"], """select sid session_id, "type", block_type, pos::int pos, count(*) blocks from (
      select sid, 'assistant' as "type", 'tool_use' block_type, 0 pos from lines where event_type = 'click'
      union all select sid, 'user', 'tool_result', 0 from lines where event_type = 'purchase' union all select sid, 'user', 'text', 0 from lines where event_type = 'signup'
      union all select sid, 'assistant', 'thinking', 0 from lines where event_type = 'view' union all select sid, 'assistant', 'text', 1 from lines where event_type = 'view') group by all""", LINES),
    "session_messages": q.with_(["ev"], f"""select {IDS}, case event_type when 'click' then 'tool-use' when 'purchase' then 'tool-result' when 'view' then 'assistant' when 'signup' then case when k % 5 = 0 then 'command' else 'user' end else 'system' end as role,
      case event_type when 'view' then 'Seen '||event_id when 'signup' then case when k % 5 = 0 then '/go '||k else 'Question '||k end else '' end content, false is_meta,
      case when event_type = 'purchase' then 't'||(k % 3) end result_id, case when event_type = 'click' then (['Read','Edit','Bash','Grep'])[(k % 4)+1]||':t'||(k % 3) else '' end tool_list,
      case when event_type in ('click','view') then cast(floor(value * 10) as bigint) end input_tokens, event_type = 'view' and k % 2 = 0 has_thinking from lines""", LINES),
    "tool_call_details": q.with_(["ev"], f"""select {IDS}, (['Read','Edit','Bash','Grep'])[(k % 4)+1] tool_name, 't'||(k % 3) tool_id,
      case k % 4 when 0 then path||' ('||(k+1)||'-'||(k+10)||')' when 1 then path when 2 then 'run '||k else 'q'||k end summary,
      case k % 4 when 0 then 'file_path='||path||'|startLine='||(k+1)||'|endLine='||(k+10) when 1 then 'file_path='||path||'|old_string=2 lines|new_string=3 lines'||case when k % 8 = 1 then '|startLine='||(k+1) else '' end
        when 2 then 'command=run '||k||'|timeout='||(k*1000) else 'query=q'||k end details from lines where event_type = 'click'""", LINES),
    "edit_texts": q.with_(["ev"], f"select {IDS}, old_text, new_text, case when k % 8 = 1 then 'line '||(k+1) end as location from edits", LINES),
    "message_block_details": q.with_(["ev"], f"""select {IDS}, 0 pos, block_type, attached, title, summary, details, content, tool_id from (
      select *, 'tool-result' block_type, false attached, 'Text' title, 'line '||(k % 12)||' keep '||(k % 5) summary, {RESULT_TEXT} content, 't'||(k % 3) tool_id,
        'tool_use_id=t'||(k % 3)||'|type=text|filePath='||path||'|exitCode='||(k % 3)||'|numLines='||k||'|totalLines='||(k*2) details from lines where event_type = 'purchase'
      union all select *, 'thinking', false, 'Thinking', case when k % 2 = 0 then length('Thought '||k)||' chars' else '' end, case when k % 2 = 0 then 'Thought '||k end, null,
        case when k % 2 = 0 then 'thinking='||length('Thought '||k)||' chars|' else '' end||'signature=sig (3 chars)' from lines where event_type = 'view'
      union all select *, 'event', true, 'Attachment: File', 'text '||k, 'text '||k, null, 'type=file|displayPath='||path||'|content.file.filePath=/home/'||user_id||'/'||path||'|content.file.numLines='||k||'|content.file.totalLines='||(k+5)||'|content.file.content='||length('text '||k)||' chars' from lines where event_type = 'error' and k % 2 = 0
      union all select *, 'event', false, 'System: Compact boundary', 'compact_boundary', null, null, 'subtype=compact_boundary|uuid=u'||event_id||'|timestamp='||tstamp||'|type=system' from lines where event_type = 'error' and k % 2 = 1)""", LINES),
    "compaction_log": q.with_(["ev"], f"select {IDS}, tstamp as timestamp, true is_compaction, false is_microcompaction, 'auto' as trigger, k pre_tokens, 0::bigint tokens_saved from lines where event_type = 'error' and k % 2 = 1", LINES),
    "log_session_summary": q.with_(["ev", "turns", "prices", "scored", "pm"], f"""select sid session_id, any_value(uc) user_count, any_value(ac) assistant_count, any_value(uc) + any_value(ac) message_count, any_value(tc) tool_count, any_value(cc) compactions, any_value(cwd) cwd,
        {q.SUM_TOKENS}, {q.sum_costs()} from (
        select b.*, u.model, coalesce(u.it,0)::bigint it, coalesce(u.ot,0)::bigint ot, coalesce(u.cw,0)::bigint cw, coalesce(u.cr,0)::bigint cr,
          {', '.join(q.micro(m, 'u.it', 'u.ot', 'u.cw', 'u.cr') + f' micro_{m}' for m in q.SHARES)}
        from (select sid, count(*) filter (where event_type in ('purchase','signup')) uc, count(*) filter (where event_type in ('click','view')) ac, count(*) filter (where event_type = 'click') tc,
            count(*) filter (where event_type = 'error' and k % 2 = 1) cc, arg_min('/home/'||user_id, event_id) filter (where event_type = 'signup') cwd from lines group by sid) b
        left join (select sid, model, sum(floor(value*10))::bigint it, sum(floor(value))::bigint ot, sum(k*10)::bigint cw, sum(k*1000)::bigint cr from lines where event_type in ('click','view') group by all) u using (sid)
        left join pm on pm.model = u.model) group by sid""", LINES),
    "log_search": q.with_(["ev"], "select pid project_id, sid session_id, min(tstamp) started_at from lines where sid in (select sid from lines where event_type = 'view' and contains('seen '||event_id, 'seen 12')) group by all", LINES),
    "edit_line_diffs": q.with_(["ev"], f"select {IDS}, path, 2::bigint added, 1::bigint removed, case when k % 8 = 1 then k + 1 end start_line from edits", LINES),
    "price_normalisation": """select model, provider, round(i * 1000000, 8) input_price, round(o * 1000000, 8) output_price, 0.0::double cache_write_price, coalesce(round(c * 1000000, 8), 0) cache_read_price from (
      select (['claude-','gpt-','o3-','ft:gpt-','azure/gpt-','gpt-image-','text-'])[(p_partkey % 7)+1]||p_partkey model, case when p_partkey % 7 = 0 then 'anthropic' else 'openai' end provider, p_partkey % 7 g,
        case when p_size % 11 <> 0 then p_size / 1000000.0::double end i, p_size / 250000.0::double o, case when p_size % 2 = 0 then p_size / 10000000.0::double end c from part) where g < 3 and i is not null""",
    "prompt_history": q.with_(["ev"], "select 'ask '||event_id display, project_id project, strftime(make_timestamp((micros // 1000) * 1000), '%Y-%m-%d %H:%M') as minute, k pasted from ev where event_id % 50 <> 3"),
}

# --- contributions, context and pairs of the log lines ---------------------------------------


def _count(text: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, '\\w{{1,6}}|[^\\w\\s]')), 0)::bigint"


_NL = "chr(92)||'n'"
GIVEN = f"""calls as (select *, '{{"name":"'||(['Read','Edit','Bash','Grep'])[(k % 4)+1]||'","input":{{'||case k % 4
      when 0 then '"endLine":'||(k+10)||',"file_path":"'||path||'","startLine":'||(k+1)
      when 1 then '"file_path":"'||path||'","new_string":"line '||(k % 12 + 4)||{_NL}||'keep '||(k % 5)||{_NL}||'added","old_string":"line '||(k % 12)||{_NL}||'keep '||(k % 5)||'"'||case when k % 8 = 1 then ',"startLine":'||(k+1) else '' end
      when 2 then '"command":"run '||k||'","timeout":'||(k*1000) else '"query":"q'||k||'"' end||'}}}}' call from lines where event_type = 'click'),
given as (
  select sid, event_id seq, 'assistant' as "type", 0::bigint system, 0::bigint conversation, 0::bigint files, 0::bigint thinking, {_count('call')} tool, 0::bigint other, 0::bigint hid, value, k from calls
  union all select sid, event_id, 'user', 0, 0, 0, 0, {_count("'{\"exitCode\":'||(k % 3)||',\"filePath\":\"'||path||'\",\"numLines\":'||k||',\"totalLines\":'||(k*2)||',\"type\":\"text\"}'")}, 0, 0, value, k from lines where event_type = 'purchase'
  union all select sid, event_id, 'assistant', 0, {_count("'Seen '||event_id")}, 0, case when k % 2 = 0 then {_count("'Thought '||k")} else 0 end, 0, 0, k % 2, value, k from lines where event_type = 'view'
  union all select sid, event_id, 'user', case when k % 5 = 0 then {_count("'<command-name>/go</command-name><command-args>'||k||'</command-args>'")} else 0 end, case when k % 5 = 0 then 0 else {_count("'Question '||k")} end, 0, 0, 0, 0, 0, value, k from lines where event_type = 'signup'
  union all select sid, event_id, 'attachment', 0, 0, {_count("path||' text '||k")}, 0, 0, 0, 0, value, k from lines where event_type = 'error' and k % 2 = 0
  union all select sid, event_id, 'system', 0, 0, 0, 0, 0, 0, 0, value, k from lines where event_type = 'error' and k % 2 = 1)"""
_SIX = ("system", "conversation", "files", "thinking", "tool", "other")
_REST = "greatest(billed - known, 0)"
CONTEXT = (
    """g1 as (select *, lag("type") over (partition by sid order by seq) pt, """
    + ", ".join(f"coalesce(sum({b}) over b, 0)::bigint p_{b}" for b in (*_SIX, "hid"))
    + """ from given window b as (partition by sid order by seq rows between unbounded preceding and 1 preceding)),
g2 as (select *, "type" <> 'assistant' or pt is null or pt <> 'assistant' f from g1),
g3 as (select sid, seq, "type", (floor(value * 10) + k * 10 + k * 1000)::bigint billed, """
    + ", ".join(f"last_value(case when f then p_{b} end ignore nulls) over w c_{b}" for b in (*_SIX, "hid"))
    + """ from g2 window w as (partition by sid order by seq)),
g4 as (select *, """
    + " + ".join(f"c_{b}" for b in _SIX)
    + """ known from g3 where "type" = 'assistant')"""
)
_LOG_FLOW = """f0 as (
  select sid, event_id seq, tstamp, k, case event_type when 'click' then 'tool-use' when 'purchase' then 'tool-result' when 'view' then 'assistant'
      when 'signup' then case when k % 5 = 0 then 'system' else 'user' end else 'system' end as "role",
    case when event_type in ('click','purchase') then 't'||(k % 3) end tid, case when event_type = 'click' then (['Read','Edit','Bash','Grep'])[(k % 4)+1] end tool
  from lines),
f1 as""" + FLOW.split("f1 as", 1)[1]

ORACLE |= {
    "prompt_contributions": q.with_(["ev"], f"""select sid session_id, seq, "type", {", ".join(_SIX)}, hid hidden_thinking from given""", LINES, GIVEN),
    "context_before_replies": q.with_(["ev"], f"""select sid session_id, seq, c_system system_tokens, c_conversation conversation_tokens, c_files files_tokens,
      c_thinking + case when c_hid > 0 then {_REST} else 0 end thinking_tokens, c_tool tool_tokens, c_other + case when c_hid > 0 then 0 else {_REST} end other_tokens,
      billed total_tokens, known > billed as overflow from g4""", LINES, GIVEN, CONTEXT),
    "log_tool_pairs": q.with_(["ev"], "select sid session_id, gid group_id, use_seq, tid tool_id, tool tool_name, result_seq, by_position from pairs", LINES, _LOG_FLOW, PAIRS),
}

# --- files in context: Read calls, tool results and attached files ----------------------------

_MENTIONED = """reads as (select sid, 't'||(k % 3) tid, arg_max(k, event_id) rk from lines where event_type = 'click' and k % 4 = 0 group by all),
mentioned as (
  select pid project_id, sid session_id, event_id seq, 0 pos, path, false in_context, false attached, null::bigint loaded_count, null::bigint total_count, k + 1 as "start", k + 10 as "end"
  from lines where event_type = 'click' and k % 4 = 0
  union all select l.pid, l.sid, l.event_id, 0, l.path, true, false, l.k, l.k * 2, r.rk + 1, r.rk + 10
  from lines l left join reads r on r.sid = l.sid and r.tid = 't'||(l.k % 3) where l.event_type = 'purchase'
  union all select pid, sid, event_id, 0, '/home/'||user_id||'/'||path, true, true, k, k + 5, null, null from lines where event_type = 'error' and k % 2 = 0)"""
_FILES = """per_path as (
  select project_id, session_id, path file_key, path full_path, bool_or(in_context) in_context, bool_or(attached) attached, min(seq) first_seq,
    max(loaded_count) loaded_count, max(total_count) total_count, count(*) mentions, regexp_extract(path, '[^/]+$') file_name from mentioned group by all),
found as (select *, first_seq = min(first_seq) over (partition by project_id, session_id, file_name) is_home from per_path)"""
_COVERED = """limits as (
  select m.project_id, m.session_id, path file_key, "start", max("end") as "end", any_value(case when f.total_count > 0 then f.total_count else 9007199254740991 end) top
  from mentioned m join found f on f.project_id = m.project_id and f.session_id = m.session_id and f.file_key = m.path
  where "start" is not null group by m.project_id, m.session_id, path, "start"),
cut as (select *, least(greatest(1, "start"), top) s from limits),
closed as (select *, least(greatest(s, "end"), top) e from cut),
seen as (select *, max(e) over (partition by project_id, session_id, file_key order by s, e rows between unbounded preceding and 1 preceding) before from closed),
islands as (select *, count(*) filter (where before is null or s > before + 1) over (partition by project_id, session_id, file_key order by s, e rows unbounded preceding) island from seen),
merged as (select project_id, session_id, file_key, island, max(e) - min(s) + 1 n from islands group by all),
covered as (select project_id, session_id, file_key, sum(n)::bigint n, count(*) ranges from merged group by all)"""

ORACLE |= {
    "file_mentions": q.with_(["ev"], "select * from mentioned", LINES, _MENTIONED),
    "context_files": q.with_(["ev"], "select * from found", LINES, _MENTIONED, _FILES),
    "context_file_messages": q.with_(["ev"], """select *, row_number() over (partition by project_id, session_id, file_key order by seq) place
      from (select distinct project_id, session_id, path file_key, seq from mentioned)""", LINES, _MENTIONED),
    "counted_contributions": ORACLE["prompt_contributions"],
    "context_file_coverage": q.with_(["ev"], """select *, percent < 100 is_partial from (
      select project_id, session_id, file_key, coalesce(n, loaded_count) loaded_lines, coalesce(ranges, 0) range_count, total_count,
        case when total_count > 0 then least(100, floor(coalesce(n, loaded_count) * 100 / total_count + 0.5))::bigint else 100 end percent
      from found left join covered using (project_id, session_id, file_key) where coalesce(n, loaded_count) is not null)""", LINES, _MENTIONED, _FILES, _COVERED),
}

# --- file changes: the fold over the edits of a file -------------------------------------------

ORACLE |= edit_answers(q.with_(["ev"], "", LINES).rstrip())
