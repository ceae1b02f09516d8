"""Queries over message flows, running context, line ranges and file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import context as C
from logloom.operators import files as FI
from logloom.operators import transcript as T
from logloom.operators.edits import change_totals, file_changes
from logloom.operators.pricing import costs_rounded
from logloom.operators.scans import chunk_of
from logloom.plans import sqlparts as q
from logloom.session import cut_lineage
from logloom.sources import tables as t
from logloom.sources.prices import default_prices

# Rows per chunk of the event id axis.
SPAN = 1 << 20
DAY_MS = 86_400_000


def _flow(spark: SparkSession, d: str, preset: str = "all") -> DataFrame:
    """Grouped messages, materialised once because several steps read them."""
    return cut_lineage(T.assign_groups(T.filter_preset(t.flow(spark, d), preset), span=SPAN))


def preset_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.preset_counts(t.flow(spark, d))


def assistant_runs(spark: SparkSession, d: str) -> DataFrame:
    grouped = T.assign_groups(t.messages(spark, d).withColumn("timestamp", F.lit(None).cast("string")), span=SPAN)
    return T.merge_runs(grouped).drop("timestamp", "is_meta")


def run_texts(spark: SparkSession, d: str) -> DataFrame:
    grouped = T.assign_groups(t.messages(spark, d), span=SPAN)
    return T.run_parts(grouped)


def message_groups(spark: SparkSession, d: str) -> DataFrame:
    return _flow(spark, d).select("session_id", "seq", "role", "group_id", "group_kind", "lead_id", "prev_seq", "prev_role")


def system_batches(spark: SparkSession, d: str) -> DataFrame:
    return T.system_batches(_flow(spark, d))


def tool_pairs(spark: SparkSession, d: str) -> DataFrame:
    return T.pair_tools(_flow(spark, d), span=SPAN).drop("use_at", "result_at", "pos")


def transcript_groups(spark: SparkSession, d: str) -> DataFrame:
    grouped = _flow(spark, d)
    return T.transcript_groups(grouped, T.pair_tools(grouped, span=SPAN)).drop("message_at", "step_start", "step_end")


def adjacent_groups(spark: SparkSession, d: str) -> DataFrame:
    grouped = _flow(spark, d, "tools")
    groups = cut_lineage(T.transcript_groups(grouped, T.pair_tools(grouped, span=SPAN)))
    return T.merge_adjacent(groups, span=SPAN).select("session_id", "group_id", "kind", "merged_groups", "messages", "last_seq", "tool_pairs")


def group_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage and costs of the groups that the tools preset shows, neighbours joined; every third message repeats an id."""
    ev = t.events_base(spark, d).select(
        F.col("event_id").alias("seq"), t.model_of_event().alias("model"), (F.col("k") % 6 != 0).alias("has_usage"),
        F.concat(F.lit("m"), F.floor(F.col("event_id") / 3).cast("string")).alias("message_id"),
        F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"), F.floor("value").cast("bigint").alias("output_tokens"),
        (F.col("k") * 10).alias("cache_write_tokens"), (F.col("k") * 1000).alias("cache_read_tokens"),
        (F.col("k") * 7).alias("cache_5m_tokens"), (F.col("k") * 3).alias("cache_1h_tokens"),
        F.when(F.col("k") % 2 == 0, "standard").otherwise("batch").alias("service_tier"),
    )
    grouped = _flow(spark, d, "tools")
    usage = T.group_usage(grouped.join(ev, "seq"), default_prices(spark))
    groups = T.transcript_groups(grouped, T.pair_tools(grouped, span=SPAN))
    merged = T.merge_adjacent(cut_lineage(T.with_usage(groups, usage)), span=SPAN).filter("usage_messages > 0")
    return merged.select("session_id", "group_id", "merged_groups", *T.USAGE, *costs_rounded(4))


def tool_filter(spark: SparkSession, d: str) -> DataFrame:
    grouped = _flow(spark, d)
    uses, _ = T.tool_steps(grouped)
    groups = grouped.groupBy("session_id", "group_id").agg(F.min_by("group_kind", "seq").alias("kind"))
    return T.filter_tool(groups, uses, "Read")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per-user groups of events split at gaps over six hours; errors are the markers."""
    from logloom.operators.scans import chunk_scan

    ev = t.events_base(spark, d).filter("event_type <> 'error'").select(
        F.col("project_id").alias("session_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")
    )
    six = 6 * 3_600_000
    part = chunk_scan(
        ev, ["session_id"], ["event_id"], chunk_of(F.col("event_id"), SPAN),
        local=[{"_p": lambda w: F.lag("ms").over(w)}],
        summary={"_t": F.max_by("ms", "event_id")},
        carry=[{"_c": lambda w: F.lag("_t").over(w)}],
    )
    prev = F.coalesce("_p", "_c")
    starts = part.withColumn("_new", F.when(prev.isNull() | (F.col("ms") - prev > six), F.col("event_id"))).select("session_id", "event_id", "ms", "_new")
    from logloom.operators.scans import running_extreme

    out = running_extreme(starts, ["session_id"], ["event_id"], chunk_of(F.col("event_id"), SPAN), "group_id", F.col("_new"))
    return out.groupBy("session_id", "group_id").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))


def compaction_markers(spark: SparkSession, d: str) -> DataFrame:
    marks = t.events_base(spark, d).filter("event_type = 'error'").select(
        F.col("project_id").alias("session_id"), F.col("event_id").alias("marker_no"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")
    )
    return T.place_markers(_gaps(spark, d), marks, ["session_id"], DAY_MS)


def marker_steps(spark: SparkSession, d: str) -> DataFrame:
    """Errors as markers in the groups of the tools preset: those inside an assistant group, placed among its tool pairs."""
    grouped = _flow(spark, d, "tools")
    pairs = cut_lineage(T.pair_tools(grouped, span=SPAN))
    groups = cut_lineage(T.transcript_groups(grouped, pairs))
    ranges = groups.withColumns({f"{e}_ms": F.unix_millis(F.col(f"{e}_at").try_cast("timestamp")) for e in ("start", "end")})
    marks = t.events_base(spark, d).filter("event_type = 'error'").select(
        F.col("project_id").alias("session_id"), F.col("event_id").alias("marker_no"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")
    )
    placed = cut_lineage(T.place_markers(ranges, marks, ["session_id"], DAY_MS))
    return T.place_in_steps(placed, groups, pairs, ["session_id"], DAY_MS)


def run_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    """The prompt breakdown of the last visible message of every assistant run."""
    parts = ["system_tokens", "conversation_tokens", "thinking_tokens", "other_tokens", "total_tokens"]
    known = prompt_breakdown(spark, d).select("session_id", "seq", F.struct(*parts).alias("breakdown"))
    rows = t.messages(spark, d).join(known, ["session_id", "seq"], "left").withColumn("timestamp", F.lit(None).cast("string"))
    runs = T.merge_runs(T.assign_groups(rows, span=SPAN))
    return runs.select("session_id", "run_id", "last_visible_seq", "breakdown.*")


def _context(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the conversations with their token estimate as one bucket per role."""
    n = C.count_tokens(F.col("content"))
    role = F.col("role")
    rows = t.messages(spark, d).select(
        "session_id", "seq", "role",
        F.when(role == "system", n).otherwise(0).alias("system"), F.when(role != "system", n).otherwise(0).alias("conversation"),
        *[F.lit(0).cast("bigint").alias(b) for b in ("files", "thinking", "tool", "other")],
        F.when((role == "user") & (F.col("seq") % 4 == 2), 1).otherwise(0).cast("bigint").alias("hidden_thinking"),
    )
    return C.running_context(rows, ["session_id"], "seq", chunk_of(F.col("seq"), SPAN), role == "assistant", [*C.BUCKETS, "hidden_thinking"])


def running_context(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).select("session_id", "seq", "ctx_system", "ctx_conversation", "ctx_hidden_thinking")


def _breakdown(spark: SparkSession, d: str) -> DataFrame:
    ctx = _context(spark, d).filter("role = 'assistant'")
    return C.prompt_breakdown(ctx.withColumns({
        "has_usage": F.col("seq") % 5 != 0, "input_tokens": F.lit(100).cast("bigint"), "cache_write_tokens": F.col("seq") * 150,
        "cache_read_tokens": F.lit(None).cast("bigint"),
    }))


def prompt_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _breakdown(spark, d).select("session_id", "seq", "system_tokens", "conversation_tokens", "thinking_tokens", "other_tokens", "total_tokens", "overflow")


def window_composition(spark: SparkSession, d: str) -> DataFrame:
    return C.window_snapshot(_breakdown(spark, d).filter("not overflow"), ["session_id"])


def range_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Line items as file mentions that answer Read calls of their order."""
    li = t.load(spark, d, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    n = F.col("l_linenumber").cast("bigint")
    mentions = li.filter(odd).select(
        F.col("l_orderkey").alias("session_id"), n.alias("seq"), "l_partkey",
        F.when(n < 6, (F.col("l_suppkey") % 3).cast("string")).alias("tool_id"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_quantity").cast("bigint")).alias("start_line"),
        F.when(F.col("l_partkey") % 4 == 0, F.col("l_partkey")).alias("end_line"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 90).alias("loaded_count"),
        F.when(F.col("l_partkey") % 7 != 0, F.lit(60).cast("bigint")).alias("total_count"),
    )
    reads = li.filter(~odd).select(
        F.col("l_orderkey").alias("session_id"), n.alias("seq"), F.col("l_partkey").alias("pos"),
        (F.col("l_suppkey") % 3).cast("string").alias("tool_id"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity").cast("bigint")).alias("start_line"), F.lit(None).cast("bigint").alias("end_line"),
    )
    return FI.resolve_ranges(mentions, reads, ["session_id"]).groupBy("session_id", "seq", "l_partkey").agg(
        F.count("*").alias("n"), F.sum("start").alias("start"), F.sum("end").alias("end")
    )


def merged_ranges(spark: SparkSession, d: str) -> DataFrame:
    return FI.merge_ranges(t.line_ranges(spark, d), ["file_key"])


def file_coverage(spark: SparkSession, d: str) -> DataFrame:
    ranges = t.line_ranges(spark, d)
    clamped = FI.clamp_ranges(ranges, F.lit(45))
    totals = ranges.select("file_key").distinct().withColumn("total_count", F.lit(45).cast("bigint"))
    return FI.file_coverage(FI.merge_ranges(clamped, ["file_key"]), ["file_key"], totals)


def range_labels(spark: SparkSession, d: str) -> DataFrame:
    return FI.range_labels(FI.merge_ranges(t.line_ranges(spark, d), ["file_key"])).select("file_key", "label")


def line_tokens(spark: SparkSession, d: str) -> DataFrame:
    cover = FI.file_coverage(FI.merge_ranges(t.line_ranges(spark, d), ["file_key"]), ["file_key"])
    return FI.line_token_estimate(cover.withColumn("part_group", F.substring("file_key", 1, 1)), ["part_group"])


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    """Given change counts: one hunk per line item, files are parts, sessions suppliers."""
    return t.load(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("session_id"), F.concat(F.lit("src/p"), F.col("l_partkey").cast("string")).alias("path"),
        F.when(F.col("l_linenumber") % 2 == 0, "net").otherwise("edit").alias("hunk_kind"),
        (F.col("l_linenumber") % 3 * F.col("l_quantity").cast("bigint")).cast("bigint").alias("added"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_linenumber")).cast("bigint").alias("removed"),
    )


def change_summary(spark: SparkSession, d: str) -> DataFrame:
    return file_changes(_hunks(spark, d), ["session_id"])


def change_total(spark: SparkSession, d: str) -> DataFrame:
    return change_totals(file_changes(_hunks(spark, d), ["session_id"]), ["session_id"])


QUERIES = {
    f.__name__: f
    for f in (
        preset_counts, assistant_runs, run_texts, message_groups, system_batches, tool_pairs, transcript_groups, adjacent_groups,
        group_usage, tool_filter, compaction_markers, marker_steps, run_breakdowns, running_context, prompt_breakdown, window_composition, range_resolution, merged_ranges,
        file_coverage, range_labels, line_tokens, change_summary, change_total,
    )
}

FLOW = """f0 as (
  select project_id sid, event_id seq, tstamp, k, case event_type when 'click' then 'tool-use' when 'purchase' then 'tool-result' when 'view' then 'assistant' when 'signup' then 'user' else 'system' end as "role",
    case when event_type in ('click','purchase') then 't'||(k % 3) end tid,
    case when event_type = 'click' then (['Bash','Edit','Read','Grep','Write'])[(k % 5)+1] end tool
  from ev{where}),
f1 as (select *, case when "role" in ('tool-use','tool-result') then 'flow' else "role" end part,
    lag(seq) over w prev_seq, lag("role") over w prev_role from f0 window w as (partition by sid order by seq)),
f2 as (select *, case when part <> 'flow' and (part = 'user' or prev_role is null or prev_role <> part) then seq end lead_here from f1),
f3 as (select *, last_value(lead_here ignore nulls) over (partition by sid order by seq) lead_id,
    last_value(case when part <> 'flow' then part end ignore nulls) over (partition by sid order by seq) lead_part from f2),
f4 as (select *, min(case when "role" = 'tool-use' then seq end) over (partition by sid, lead_id order by seq) first_use from f3),
flow as (select *, part = 'flow' and lead_part = 'assistant' after_a,
    case when part <> 'flow' or lead_part = 'assistant' then lead_id else coalesce(first_use, seq) end gid,
    case when part = 'flow' then 'assistant' else part end kind from f4)"""
PAIRS = """steps as (
  select *, case "role" when 'tool-use' then 1 else -1 end s from flow where part = 'flow'),
bal as (select *, sum(s) over w b, count(*) filter (where s = 1) over w u, count(*) filter (where s = -1) over w r
  from steps window w as (partition by sid, coalesce(lead_id,-1), tid order by seq)),
low as (select *, least(0, min(b) over (partition by sid, coalesce(lead_id,-1), tid order by seq)) lo,
    least(0, min(b) over (partition by sid, coalesce(lead_id,-1), tid order by seq rows between unbounded preceding and 1 preceding)) plo from bal),
ranked as (select *, case when s = 1 then u when lo = plo then r + lo end rk from low),
fifo as (select a.sid, a.seq use_seq, b.seq res_seq from ranked a join ranked b on a.sid = b.sid and coalesce(a.lead_id,-1) = coalesce(b.lead_id,-1) and a.tid = b.tid and a.rk = b.rk where a.s = 1 and b.s = -1),
spare as (select * from flow where "role" = 'tool-result' and seq not in (select res_seq from fifo)),
used as (select f.*, fifo.res_seq, case when fifo.res_seq is null and f.after_a then n.seq end next_seq from flow f
  left join fifo on fifo.use_seq = f.seq left join spare n on n.after_a and n.prev_role = 'tool-use' and n.prev_seq = f.seq and n.sid = f.sid where f."role" = 'tool-use'),
pairs as (
  select sid, gid, seq use_seq, tid, tool, coalesce(res_seq, next_seq) result_seq, next_seq is not null by_position from used
  union all select sid, gid, null, tid, null, seq, false from spare where seq not in (select next_seq from used where next_seq is not null))"""
GROUPS = """groups as (
  select g.sid, g.gid, kind, messages, last_seq, visible, coalesce(n,0) n_pairs, coalesce(a,0) n_answered,
    least(message_at, step_start) start_at, greatest(message_at, step_end) end_at from (
    select sid, gid, first(kind order by seq) kind, count(*) messages, max(seq) last_seq, count(*) filter (where "role" = 'assistant') visible,
      coalesce(arg_max(tstamp, seq) filter (where "role" = 'assistant' or ("role" = 'tool-use' and not after_a))) message_at,
      min(tstamp) filter (where kind <> 'assistant' or part = 'flow') step_start, max(tstamp) filter (where kind <> 'assistant' or part = 'flow') step_end
    from (select * replace (coalesce(after_a, false) as after_a) from flow) group by all) g
  left join (select sid, gid, count(*) n, count(*) filter (where use_seq is not null and result_seq is not null) a from pairs group by all) p using (sid, gid)
  where kind <> 'assistant' or visible > 0 or coalesce(n,0) > 0)"""
F_ALL = FLOW.format(where="")
F_TOOLS = FLOW.format(where=" where event_type <> 'error'")
RUNS = """c0 as (select cast(conv_id as varchar) sid, turn seq, role, text, lag(role) over (partition by conv_id order by turn) pr from conversations),
c1 as (select *, sum(case when role <> pr or pr is null or role = 'user' then 1 else 0 end) over (partition by sid order by seq) run from c0),
tr as (select *, regexp_replace(text, '\\A[\\s\\x0B\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+|[\\s\\x0B\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+\\z', '', 'g') clean,
  min(seq) over (partition by sid, run) run_id from c1 where role = 'assistant')"""
CTX = """m0 as (select cast(conv_id as varchar) sid, turn seq, role, len(regexp_extract_all(regexp_replace(text, '\\A[\\s\\x0B\\x{A0}]+|[\\s\\x0B\\x{A0}]+\\z', '', 'g'), '\\w{1,6}|[^\\w\\s]'))::bigint n,
    case when role = 'user' and turn % 4 = 2 then 1 else 0 end hid from conversations),
m1 as (select *, coalesce(lag(role) over (partition by sid order by seq), '') pr,
    coalesce(sum(case when role = 'system' then n else 0 end) over b, 0)::bigint s, coalesce(sum(case when role <> 'system' then n else 0 end) over b, 0)::bigint c, coalesce(sum(hid) over b, 0)::bigint h
  from m0 window b as (partition by sid order by seq rows between unbounded preceding and 1 preceding)),
ctx as (select sid, seq, role, last_value(case when f then s end ignore nulls) over w cs, last_value(case when f then c end ignore nulls) over w cc, last_value(case when f then h end ignore nulls) over w ch
  from (select *, role <> 'assistant' or pr <> 'assistant' f from m1) window w as (partition by sid order by seq)),
bd as (select sid, seq, billed, cs + cc known, billed is not null and cs + cc > billed ovf,
    cs system_tokens, cc conversation_tokens, case when ch > 0 then greatest(coalesce(billed - cs - cc, 0), 0) else 0 end thinking_tokens,
    case when ch > 0 then 0 else greatest(coalesce(billed - cs - cc, 0), 0) end other_tokens
  from (select *, case when seq % 5 <> 0 then 100 + seq * 150 end billed from ctx where role = 'assistant'))"""
ISLANDS = """r0 as (select cast(l_partkey as varchar) file_key, {start} s, {end} e from lineitem),
r1 as (select *, max(e) over (partition by file_key order by s, e rows between unbounded preceding and 1 preceding) pm from r0),
r2 as (select *, sum(case when pm is null or s > pm + 1 then 1 else 0 end) over (partition by file_key order by s, e) isl from r1),
isl as (select file_key, min(s)::bigint s, max(e)::bigint e from r2 group by file_key, isl)"""
PLAIN = ISLANDS.format(start="cast(l_quantity as int)", end="cast(l_quantity as int) + l_linenumber - 1")
CUT = ISLANDS.format(start="least(greatest(1, cast(l_quantity as int)), 45)", end="least(greatest(least(greatest(1, cast(l_quantity as int)), 45), cast(l_quantity as int) + l_linenumber - 1), 45)")
CHANGES = """ch as (select cast(l_suppkey as varchar) session_id, 'src/p'||l_partkey path, coalesce(sum(a) filter (where net),0)::bigint added, coalesce(sum(r) filter (where net),0)::bigint removed, count(*) filter (where not net) edits
  from (select *, l_linenumber % 2 = 0 net, (l_linenumber % 3) * cast(l_quantity as bigint) a, case when l_returnflag = 'R' then 0 else l_linenumber end r from lineitem) group by all)"""

ORACLE = {
    "preset_counts": q.with_(["ev"], """select sid session_id, count(*) filter (where "role" in ('user','assistant')) narrative, count(*) filter (where "role" <> 'system') tools, count(*) as "all" from flow group by sid""", F_ALL),
    "assistant_runs": "with " + RUNS + " select sid session_id, run_id, count(*) messages, count(*) filter (where clean <> '') visible_messages, sum(length(clean))::bigint chars, max(seq) filter (where clean <> '') last_visible_seq from tr group by all having count(*) filter (where clean <> '') > 0",
    "run_texts": "with " + RUNS + " select sid session_id, run_id, seq, clean as text from tr where clean <> ''",
    "message_groups": q.with_(["ev"], """select sid session_id, seq, "role", gid group_id, kind group_kind, lead_id, prev_seq, prev_role from flow""", F_ALL),
    "system_batches": q.with_(["ev"], "select sid session_id, lead_id batch_id, count(*) messages, max(seq) last_seq from flow where kind = 'system' group by all", F_ALL),
    "tool_pairs": q.with_(["ev"], "select sid session_id, gid group_id, use_seq, tid tool_id, tool tool_name, result_seq, by_position from pairs", F_ALL, PAIRS),
    "transcript_groups": q.with_(["ev"], "select sid session_id, gid group_id, kind, messages, last_seq, visible visible_messages, n_pairs tool_pairs, n_answered answered_pairs, start_at, end_at from groups", F_ALL, PAIRS, GROUPS),
    "adjacent_groups": q.with_(["ev"], """select sid session_id, min(gid) group_id, first(kind order by gid) kind, count(*) merged_groups, sum(messages)::bigint messages, max(last_seq) last_seq, sum(n_pairs)::bigint tool_pairs
      from (select *, sum(case when pk is null or kind <> 'assistant' or pk <> kind then 1 else 0 end) over (partition by sid order by gid) rn from (select *, lag(kind) over (partition by sid order by gid) pk from groups)) group by sid, rn""", F_TOOLS, PAIRS, GROUPS),
    "group_usage": q.with_(["ev", "turns", "prices", "scored", "pm"], f"""select sid session_id, min(gid) group_id, count(*) merged_groups, {q.SUM_TOKENS}, sum(c5)::bigint cache_5m_tokens, sum(c1)::bigint cache_1h_tokens,
      sum(n)::bigint usage_messages, {q.sum_costs()} from (select *, sum(case when pk is null or kind <> 'assistant' or pk <> kind then 1 else 0 end) over (partition by sid order by gid) rn
        from (select *, lag(kind) over (partition by sid order by gid) pk from groups)) left join gu using (sid, gid) group by sid, rn having sum(n) > 0""", F_TOOLS, PAIRS, GROUPS,
        "um as (select f.sid, f.gid, f.seq, event_id // 3 ident, e.model, cast(floor(value*10) as bigint) it, cast(floor(value) as bigint) ot, e.k*10 cw, e.k*1000 cr, e.k*7 c5, e.k*3 c1 from flow f join ev e on e.event_id = f.seq "
        "where e.k % 6 <> 0 and (f.\"role\" = 'assistant' or (f.\"role\" = 'tool-use' and not coalesce(f.after_a, false))))",
        "ul as (select * from um qualify row_number() over (partition by sid, gid, ident order by seq desc) = 1)",
        "gm as (select sid, gid, model, sum(it)::bigint it, sum(ot)::bigint ot, sum(cw)::bigint cw, sum(cr)::bigint cr, sum(c5)::bigint c5, sum(c1)::bigint c1, count(*) n from ul group by all)",
        f"gu as (select sid, gid, sum(it) it, sum(ot) ot, sum(cw) cw, sum(cr) cr, sum(c5) c5, sum(c1) c1, sum(n) n, {q.sum_micros()} from (select gm.*, {q.micros()} from gm left join pm using (model)) group by all)"),
    "tool_filter": q.with_(["ev"], """select sid session_id, gid group_id, first(kind order by seq) kind from flow group by all having first(kind order by seq) = 'user' or (first(kind order by seq) = 'assistant' and bool_or(tool = 'Read'))""", F_ALL),
    "compaction_markers": q.with_(["ev"], """select m.sid session_id, marker_no, at_ms, m.gid group_id, case when m.gid is null then 'tail' when at_ms < start_ms then 'before' else 'inside' end placement from (
      select a.sid, a.seq marker_no, a.ms at_ms, (select min(gid) from gr where gr.sid = a.sid and gr.end_ms >= a.ms) gid from e0 a where event_type = 'error') m left join gr on gr.sid = m.sid and gr.gid = m.gid""",
        "e0 as (select project_id sid, event_id seq, micros // 1000 ms, event_type from ev)",
        "e1 as (select *, case when lag(ms) over w is null or ms - lag(ms) over w > 21600000 then seq end st from e0 where event_type <> 'error' window w as (partition by sid order by seq))",
        "gr as (select sid, gid, min(ms) start_ms, max(ms) end_ms from (select *, last_value(st ignore nulls) over (partition by sid order by seq) gid from e1) group by all)"),
    "marker_steps": q.with_(["ev"], """select m.sid session_id, marker_no, ms at_ms, m.gid group_id, x.sq step_seq, x.pos step_pos, case when x.sq is null then 'end' when ms < x.s then 'before' else 'after' end step_side
      from inside m left join st x on x.sid = m.sid and x.gid = m.gid and x.sq = (select min(sq) from st y where y.sid = m.sid and y.gid = m.gid and y.e >= m.ms)""",
        F_TOOLS, PAIRS, GROUPS,
        "mk as (select project_id sid, event_id marker_no, micros // 1000 ms from ev where event_type = 'error')",
        "gt as (select *, epoch_ms(strptime(start_at, '%Y-%m-%dT%H:%M:%S.%gZ')) s, epoch_ms(strptime(end_at, '%Y-%m-%dT%H:%M:%S.%gZ')) e from groups)",
        "tg as (select m.*, (select min(gid) from gt where gt.sid = m.sid and gt.e >= m.ms) gid from mk m)",
        "inside as (select tg.* from tg join gt using (sid, gid) where ms >= s and kind = 'assistant')",
        "tm as (select event_id seq, micros // 1000 ms from ev)",
        "st as (select p.sid, p.gid, coalesce(use_seq, result_seq) sq, 0 pos, least(u.ms, r.ms) s, greatest(u.ms, r.ms) e from pairs p left join tm u on u.seq = use_seq left join tm r on r.seq = result_seq)"),
    "run_breakdowns": "with " + RUNS + ", " + CTX + """ select l.sid session_id, run_id, last_visible_seq, system_tokens, conversation_tokens, thinking_tokens::bigint thinking_tokens, other_tokens::bigint other_tokens, coalesce(billed, known) total_tokens
      from (select sid, run_id, max(seq) filter (where clean <> '') last_visible_seq from tr group by all having count(*) filter (where clean <> '') > 0) l left join bd on bd.sid = l.sid and bd.seq = last_visible_seq""",
    "running_context": "with " + CTX + " select sid session_id, seq, cs ctx_system, cc ctx_conversation, ch ctx_hidden_thinking from ctx",
    "prompt_breakdown": "with " + CTX + " select sid session_id, seq, system_tokens, conversation_tokens, thinking_tokens::bigint thinking_tokens, other_tokens::bigint other_tokens, coalesce(billed, known) total_tokens, ovf as overflow from bd",
    "window_composition": "with " + CTX + """, lastp as (select sid, arg_max(seq, seq) seq from bd where not ovf group by sid)
      select sid session_id, segment, tokens, total from (select sid, coalesce(billed, known) total, unnest(['system','conversation','thinking','other']) segment, unnest([system_tokens, conversation_tokens, thinking_tokens, other_tokens])::bigint tokens
        from bd join lastp using (sid, seq)) where tokens > 0""",
    "range_resolution": """with rd as (select l_orderkey o, cast(l_suppkey % 3 as varchar) tid, arg_max({'s': case when l_partkey % 2 = 0 then cast(l_quantity as bigint) end}, l_linenumber::bigint * 1000000000 + l_partkey) v from lineitem where l_linenumber % 2 = 0 group by all),
      mn as (select l_orderkey o, l_linenumber::bigint seq, l_partkey, case when l_linenumber < 6 then cast(l_suppkey % 3 as varchar) end tid, case when l_partkey % 3 = 0 then cast(l_quantity as bigint) end s, case when l_partkey % 4 = 0 then l_partkey end e,
        case when l_partkey % 5 <> 0 then l_partkey % 90 end n, case when l_partkey % 7 <> 0 then 60 end tot from lineitem where l_linenumber % 2 = 1),
      j as (select mn.*, v is not null has, coalesce(s, v.s) a0 from mn left join rd using (o, tid)),
      k as (select *, coalesce(a0, case when n > 0 then e - n + 1 end) a, coalesce(e, case when n > 0 then a0 + n - 1 end) b from j),
      x as (select *, case when a is not null and b is not null then greatest(1, least(a, b)) when has and n is not null and tot is not null then 1 end rs,
        case when a is not null and b is not null then greatest(1, a, b) when has and n is not null and tot is not null then least(n, tot) end re from k)
      select o session_id, seq, l_partkey, count(*) n, sum(rs)::bigint as start, sum(re)::bigint as "end" from x group by all""",
    "merged_ranges": "with " + PLAIN + ' select file_key, s as start, e as "end" from isl',
    "file_coverage": "with " + CUT + " select file_key, sum(e - s + 1)::bigint loaded_lines, count(*) range_count, 45::bigint total_count, least(100, floor(sum(e - s + 1) * 100 / 45 + 0.5))::bigint percent, least(100, floor(sum(e - s + 1) * 100 / 45 + 0.5)) < 100 is_partial from isl group by file_key",
    "range_labels": "with " + PLAIN + " select file_key, 'L'||s||'-'||e as label from isl",
    "line_tokens": "with " + PLAIN + " select substr(file_key, 1, 1) part_group, sum(e - s + 1)::bigint loaded_lines, (sum(e - s + 1) * 4)::bigint token_estimate from isl group by 1",
    "change_summary": "with " + CHANGES + " select *, case when added > 0 and removed = 0 then 'added' when removed > 0 and added = 0 then 'deleted' else 'modified' end status from ch",
    "change_total": "with " + CHANGES + " select session_id, count(*) files, sum(added)::bigint added, sum(removed)::bigint removed, sum(edits)::bigint edits from ch group by session_id",
}
