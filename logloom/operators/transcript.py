"""Conversation reconstruction: groups, tool pairing and compaction markers.

Messages: ``session_id`` (or other keys), ``seq``, ``role``, ``content``, ``timestamp`` and, where
used, ``tools`` (array of id and name), ``result_id``, ``is_meta``, ``has_thinking``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import non_empty, trim_space
from logloom.operators.pricing import MICRO, TOKENS
from logloom.operators.scans import LINE_SPAN, chunk_of, chunk_scan, number_runs
from logloom.operators.turns import merge_usage

# Roles each preset shows.
PRESETS = {
    "narrative": ("user", "assistant"),
    "tools": ("user", "assistant", "tool-use", "tool-result", "command"),
    "all": ("user", "assistant", "tool-use", "tool-result", "command", "system"),
}
SESSION = ["session_id"]
USAGE = [*TOKENS, "cache_5m_tokens", "cache_1h_tokens", "usage_messages"]


def filter_preset(messages: DataFrame, preset: str) -> DataFrame:
    return messages if preset == "all" else messages.filter(F.col("role").isin(*PRESETS[preset]))


def preset_counts(messages: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Messages each preset shows, per session."""
    counts = [F.count_if(F.col("role").isin(*roles)).alias(name) for name, roles in PRESETS.items() if name != "all"]
    return messages.groupBy(*keys).agg(*counts, F.count("*").alias("all"))


def _upto(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def assign_groups(messages: DataFrame, keys: list[str] = SESSION, span: int = LINE_SPAN) -> DataFrame:
    """Add the group of every message in one chunked pass.

    ``lead_id``: seq at which the latest user, assistant run or system batch began; ``group_id``: seq of
    the first message of the group; ``group_kind``: user, assistant or system. Tool calls and results
    after an assistant belong to its group. Without one, the first call opens a group for the rest of
    the section and earlier results stand alone. ``prev_seq`` and ``prev_role`` are of the row before.
    """
    role = F.col("role")
    part = F.when(role.isin("tool-use", "tool-result"), "flow").when(role.isin("system", "command"), "system").otherwise(role)
    rows = messages.withColumn("_part", part)
    leads = F.col("_part") != "flow"
    batched = F.col("_part").isin("assistant", "system")
    head = F.col("_row") == 1
    known = leads & (~batched | (~head & (F.col("_prev") != F.col("_part"))))
    use_seq = F.when(role == "tool-use", F.col("seq"))
    # State of the chunk's head section until its first known lead: does it start anew or go on?
    fresh = (F.col("_hpart") != "flow") & (~F.col("_hpart").isin("assistant", "system") | F.col("_ptail").isNull() | (F.col("_ptail") != F.col("_hpart")))
    across = lambda *extra: Window.partitionBy(*keys, *extra).orderBy("_chunk")

    out = chunk_scan(
        rows, keys, ["seq"], chunk_of(F.col("seq"), span),
        local=[
            {
                "_prev": lambda w: F.lag("_part").over(w), "_row": lambda w: F.row_number().over(w),
                "_lprev": lambda w: F.lag(F.struct("seq", "role")).over(w),
            },
            {
                "_llead": lambda w: F.last(F.when(known, F.struct(F.col("seq").alias("id"), F.col("_part").alias("part"))), True).over(_upto(w)),
            },
            {"_luse": lambda w: F.min(use_seq).over(_upto(Window.partitionBy(*keys, "_chunk", "_llead").orderBy("seq")))},
        ],
        summary={
            "_head": F.min_by(F.struct("seq", F.col("_part").alias("part")), "seq"),
            "_tail": F.max_by(F.struct("seq", "role", F.col("_part").alias("part"), F.col("_llead").alias("lead"), F.col("_luse").alias("use")), "seq"),
        },
        carry=[
            {
                "_ptail": lambda w: F.lag("_tail.part").over(w), "_cprev": lambda w: F.lag(F.struct("_tail.seq", "_tail.role")).over(w),
                "_hpart": lambda w: F.col("_head.part"),
            },
            # A head that starts a batch is a lead of its own; otherwise the lead is inherited.
            {"_hlead": lambda w: F.when(fresh, F.struct(F.col("_head.seq").alias("id"), F.col("_head.part").alias("part")))},
            {"_elead": lambda w: F.coalesce("_tail.lead", "_hlead")},
            {"_clead": lambda w: F.coalesce(F.col("_hlead"), F.last("_elead", True).over(_before(w)))},
            # First call since the lead: restart counting at every chunk that brings a new lead.
            {"_seg": lambda w: F.sum(F.when(F.col("_elead").isNotNull(), 1).otherwise(0)).over(_upto(w))},
            {"_iuse": lambda w: F.min("_tail.use").over(_upto(across("_seg")))},
            {"_cuse": lambda w: F.when(F.col("_hlead").isNull(), F.lag("_iuse").over(w)), "_clead": lambda w: F.col("_clead"), "_cprev": lambda w: F.col("_cprev")},
        ],
    )
    lead = F.coalesce("_llead", "_clead")
    use = F.when(F.col("_llead").isNotNull(), F.col("_luse")).otherwise(F.coalesce("_cuse", "_luse"))
    prev = F.coalesce("_lprev", "_cprev")
    out = out.withColumns({"lead_id": lead["id"], "_lpart": lead["part"], "_use": use, "prev_seq": prev["seq"], "prev_role": prev["role"]})
    flow = F.col("_part") == "flow"
    alone = flow & (F.col("_lpart").isNull() | (F.col("_lpart") != "assistant"))
    group = F.when(alone, F.coalesce("_use", "seq")).otherwise(F.col("lead_id"))
    kind = F.when(flow, "assistant").otherwise(F.col("_part"))
    return out.withColumns({"group_id": group, "group_kind": kind, "after_assistant": flow & ~alone}).drop(
        "_part", "_prev", "_row", "_lprev", "_llead", "_luse", "_clead", "_cuse", "_cprev", "_lpart", "_use"
    )


def merge_runs(grouped: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """One row per run of assistant messages: counts and the fields of the last visible message.

    A ``breakdown`` column, such as a struct of :func:`context.prompt_breakdown`, is that of the last visible message, even if NULL.
    The text stays in long form, see :func:`run_parts`: a run has no size limit.
    """
    rows = _assistant_rows(grouped)
    seen = F.when(F.col("visible"), F.col("seq"))
    last = [F.max_by("breakdown", seen).alias("breakdown")] if "breakdown" in rows.columns else []
    out = rows.groupBy(*keys, F.col("lead_id").alias("run_id")).agg(
        F.count("*").alias("messages"), F.count_if("visible").alias("visible_messages"),
        F.sum(F.when(F.col("text") != "", F.length("text")).otherwise(0)).alias("chars"),
        F.max_by("seq", seen).alias("last_visible_seq"), F.bool_or(F.coalesce("is_meta", F.lit(False))).alias("is_meta"),
        *[F.coalesce(F.max_by(non_empty(F.col(c)), seen), F.min_by(non_empty(F.col(c)), "seq")).alias(c) for c in ("timestamp", "model", "stop_reason") if c in rows.columns],
        *last,
    )
    return out.filter("visible_messages > 0")


def _assistant_rows(grouped: DataFrame) -> DataFrame:
    return _shown(grouped.filter("role = 'assistant'"))


def _shown(grouped: DataFrame) -> DataFrame:
    """Add ``text`` (trimmed) and ``visible``: there is text, a tool call or thinking."""
    rows = grouped.withColumn("text", trim_space(F.col("content")))
    for name, kind in (("is_meta", "boolean"), ("has_thinking", "boolean"), ("tools", "array<struct<id:string,name:string>>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    n_tools = F.greatest(F.coalesce(F.size("tools"), F.lit(0)), F.lit(0))
    return rows.withColumn("visible", (F.col("text") != "") | (n_tools > 0) | F.coalesce("has_thinking", F.lit(False)))


def run_parts(grouped: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """The texts of each run in order; joined by blank lines they are the merged message."""
    rows = _assistant_rows(grouped).filter("visible and text <> ''")
    return rows.select(*keys, F.col("lead_id").alias("run_id"), "seq", "text")


def system_batches(grouped: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """One row per run of consecutive system and command messages."""
    return grouped.filter("group_kind = 'system'").groupBy(*keys, F.col("lead_id").alias("batch_id")).agg(
        F.count("*").alias("messages"), F.max("seq").alias("last_seq")
    )


def tool_steps(grouped: DataFrame, keys: list[str] = SESSION) -> tuple[DataFrame, DataFrame]:
    """(uses, results): one row per tool call (``inline`` when made by an assistant text) and result."""
    lead = F.coalesce("lead_id", F.lit(-1).cast("bigint"))
    base = [*keys, "seq", lead.alias("section"), "group_id", "timestamp"]
    callers = grouped.filter("role in ('assistant', 'tool-use')")
    uses = callers.select(
        *base, (F.col("role") == "assistant").alias("inline"), "after_assistant", "role", F.posexplode_outer("tools").alias("pos", "t")
    ).filter("t is not null or role = 'tool-use'")
    uses = uses.select(
        *keys, "seq", "section", "group_id", "timestamp", "inline", "after_assistant", F.coalesce("pos", F.lit(0)).alias("pos"),
        non_empty(F.col("t.id")).alias("tool_id"), F.col("t.name").alias("tool_name"),
    )
    results = grouped.filter("role = 'tool-result'").select(
        *base, "after_assistant", non_empty(F.col("result_id")).alias("tool_id"), "prev_seq", "prev_role"
    )
    return uses, results


def match_first_in_first_out(uses: DataFrame, results: DataFrame, keys: list[str], span: int = LINE_SPAN) -> DataFrame:
    """Calls and the results that answer them: keys, use_seq, use_pos, answer_seq.

    Each result answers the earliest open call of its tool id and section before it. With +1 per call
    and -1 per result, the results without an open call are exactly those at which the running sum
    reaches a new low below zero; the others match calls in order, so equal ranks meet.
    """
    by = [*keys, "section", "tool_id"]
    rows = uses.select(*by, "seq", "pos", F.lit(1).alias("step")).unionByName(
        results.select(*by, "seq", F.lit(0).alias("pos"), F.lit(-1).alias("step"))
    ).filter("tool_id is not null")
    out = chunk_scan(
        rows, by, ["seq", "pos"], chunk_of(F.col("seq"), span),
        local=[
            {
                "_b": lambda w: F.sum("step").over(_upto(w)),
                "_u": lambda w: F.sum(F.when(F.col("step") == 1, 1).otherwise(0)).over(_upto(w)),
                "_r": lambda w: F.sum(F.when(F.col("step") == -1, 1).otherwise(0)).over(_upto(w)),
            },
            {"_low": lambda w: F.min("_b").over(_upto(w)), "_plow": lambda w: F.min("_b").over(_before(w))},
        ],
        summary={"_tb": F.sum("step"), "_tu": F.count_if(F.col("step") == 1), "_tr": F.count_if(F.col("step") == -1), "_tl": F.min("_b")},
        carry=[
            {"_cb": lambda w: F.coalesce(F.sum("_tb").over(_before(w)), F.lit(0)), "_cu": lambda w: F.coalesce(F.sum("_tu").over(_before(w)), F.lit(0)), "_cr": lambda w: F.coalesce(F.sum("_tr").over(_before(w)), F.lit(0))},
            {"_cl": lambda w: F.min(F.col("_cb") + F.col("_tl")).over(_before(w)), **{c: (lambda w, c=c: F.col(c)) for c in ("_cb", "_cu", "_cr")}},
        ],
    )
    zero = F.lit(0)
    low = F.least(zero, F.col("_cl"), F.col("_cb") + F.col("_low"))
    before = F.least(zero, F.col("_cl"), F.col("_cb") + F.col("_plow"))
    rank = F.when(F.col("step") == 1, F.col("_cu") + F.col("_u")).when(low == before, F.col("_cr") + F.col("_r") + low)
    ranked = out.select(*by, "seq", "pos", "step", rank.alias("rank")).filter("rank is not null")
    call, answer = F.col("step") == 1, F.col("step") == -1
    met = ranked.groupBy(*by, "rank").agg(
        F.max(F.when(call, F.col("seq"))).alias("use_seq"), F.max(F.when(call, F.col("pos"))).alias("use_pos"),
        F.max(F.when(answer, F.col("seq"))).alias("answer_seq"),
    )
    return met.filter("use_seq is not null and answer_seq is not null").select(*keys, "use_seq", "use_pos", "answer_seq")


def pair_tools(grouped: DataFrame, keys: list[str] = SESSION, span: int = LINE_SPAN) -> DataFrame:
    """Pairs of tool calls and results per group; either side may be missing.

    An unanswered call after an assistant takes the result directly behind it. Calls made inside an
    assistant text appear only when answered.
    """
    uses, results = tool_steps(grouped, keys)
    met = match_first_in_first_out(uses, results, keys, span)
    answered = met.select(*keys, F.col("answer_seq").alias("seq"), "use_seq", "use_pos")
    # Is the first call of the message before already answered?
    before = met.filter("use_pos = 0").select(*keys, F.col("use_seq").alias("prev_seq"), F.lit(True).alias("_met"))
    placed = results.join(answered, [*keys, "seq"], "left").join(before, [*keys, "prev_seq"], "left")
    behind = F.col("use_seq").isNull() & F.col("after_assistant") & (F.col("prev_role") == "tool-use") & F.col("_met").isNull()
    behind = F.coalesce(behind, F.lit(False))
    # Results without a call get a key of their own, so they do not meet in one task.
    own = -F.col("seq") - 2
    placed = placed.select(
        *keys, F.when(behind, F.col("prev_seq")).otherwise(F.coalesce("use_seq", own)).alias("_use"),
        F.when(behind, 0).otherwise(F.coalesce("use_pos", F.lit(0))).alias("pos"), F.col("seq").alias("result_seq"),
        F.col("group_id").alias("_group"), F.col("tool_id").alias("_tool"), behind.alias("by_position"), F.col("timestamp").alias("result_at"),
    )
    calls = uses.withColumns({"_use": F.col("seq"), "use_seq": F.col("seq")})
    both = calls.join(placed, [*keys, "_use", "pos"], "full").filter("use_seq is null or not inline or result_seq is not null")
    return both.select(
        *keys, F.coalesce("group_id", "_group").alias("group_id"), "use_seq", "pos",
        F.when(F.col("use_seq").isNull(), F.col("_tool")).otherwise(F.col("tool_id")).alias("tool_id"), "tool_name", "result_seq",
        F.coalesce("by_position", F.lit(False)).alias("by_position"), F.col("timestamp").alias("use_at"), "result_at",
    )


def _speaks() -> Column:
    """Whether a message makes up the text of its group: an assistant message, or a call that no assistant message precedes."""
    return (F.col("role") == "assistant") | ((F.col("role") == "tool-use") & ~F.coalesce("after_assistant", F.lit(False)))


def group_usage(grouped: DataFrame, prices: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Merged usage and costs per group (see :func:`turns.merge_usage`) of the messages that make up its text.

    Needs message_id, model, has_usage, the token counters, cache_5m_tokens, cache_1h_tokens and service_tier beside
    what :func:`assign_groups` gives. Groups without any usage are absent.
    """
    return merge_usage(grouped.filter(_speaks()), prices, [*keys, "group_id"]).withColumnRenamed("messages", "usage_messages")


def with_usage(groups: DataFrame, usage: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """Add :func:`group_usage` to groups; :func:`merge_adjacent` then sums it over the groups it joins."""
    return groups.join(usage, [*keys, "group_id"], "left")


def transcript_groups(grouped: DataFrame, pairs: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """One row per group: kind, size, pair counts and time range.

    The range of an assistant group spans its last visible message and its tool steps. Assistant
    groups with nothing to show are left out.
    """
    rows = _shown(grouped)
    ts = non_empty(F.col("timestamp"))
    speaks = _speaks()
    step = (F.col("group_kind") != "assistant") | F.col("role").isin("tool-use", "tool-result")
    size = rows.groupBy(*keys, "group_id").agg(
        F.min_by("group_kind", "seq").alias("kind"), F.count("*").alias("messages"), F.max("seq").alias("last_seq"),
        F.count_if((F.col("role") == "assistant") & F.col("visible")).alias("visible_messages"),
        F.coalesce(F.max_by(ts, F.when(speaks & F.col("visible"), F.col("seq"))), F.min_by(ts, F.when(speaks, F.col("seq")))).alias("message_at"),
        F.min(F.when(step, ts)).alias("step_start"), F.max(F.when(step, ts)).alias("step_end"),
    )
    count = pairs.groupBy(*keys, "group_id").agg(
        F.count("*").alias("tool_pairs"), F.count_if(F.col("use_seq").isNotNull() & F.col("result_seq").isNotNull()).alias("answered_pairs"),
        F.min(non_empty(F.col("use_at"))).alias("use_start"), F.max(non_empty(F.col("use_at"))).alias("use_end"),
    )
    zero = F.lit(0).cast("bigint")
    out = size.join(count, [*keys, "group_id"], "left")
    out = out.withColumns({c: F.coalesce(F.col(c), zero) for c in ("tool_pairs", "answered_pairs")})
    out = out.withColumns({"step_start": F.least("step_start", "use_start"), "step_end": F.greatest("step_end", "use_end")})
    out = _with_range(out.drop("use_start", "use_end"))
    return out.filter("kind <> 'assistant' or visible_messages > 0 or tool_pairs > 0")


def _with_range(groups: DataFrame) -> DataFrame:
    return groups.withColumns(
        {"start_at": F.least("message_at", "step_start"), "end_at": F.greatest("message_at", "step_end")}
    )


def merge_adjacent(groups: DataFrame, keys: list[str] = SESSION, span: int = LINE_SPAN) -> DataFrame:
    """Join neighbouring assistant groups into one (the tools preset); usage, where there is any, is added up."""
    runs = number_runs(
        groups, keys, "group_id", chunk_of(F.col("group_id"), span), F.col("kind"), F.col("kind") != "assistant"
    )
    at = F.col("message_at")
    shown = F.when((F.col("visible_messages") > 0) & at.isNotNull(), F.col("group_id"))
    merged = runs.groupBy(*keys, "run_no").agg(
        F.min("group_id").alias("group_id"), F.min_by("kind", "group_id").alias("kind"), F.count("*").alias("merged_groups"),
        F.max("last_seq").alias("last_seq"), F.coalesce(F.max_by("message_at", shown), F.max_by("message_at", F.when(at.isNotNull(), F.col("group_id")))).alias("message_at"),
        F.min("step_start").alias("step_start"), F.max("step_end").alias("step_end"),
        *[F.sum(c).alias(c) for c in ("messages", "visible_messages", "tool_pairs", "answered_pairs")],
        *[F.sum(c).alias(c) for c in USAGE if c in runs.columns],
        *[F.sum(c).cast("decimal(38,10)").alias(c) for c in MICRO if c in runs.columns],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("group_id"))).alias(c) for c in ("service_tier",) if c in runs.columns],
    )
    return _with_range(merged.drop("run_no"))


def place_markers(groups: DataFrame, markers: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Put each marker at the first group that ends at or after it.

    ``groups``: keys, group_id, start_ms, end_ms; ``markers``: keys, marker_no, at_ms. ``placement`` is
    ``before`` or ``inside`` the group, or ``tail``. Groups without time are skipped. Instead of an
    inequality join, both sides are scanned once in descending time with a running minimum; equal
    times are reduced to one row beforehand, so a chunk of ``span`` milliseconds is bounded.
    """
    ends = groups.filter("end_ms is not null").groupBy(*keys, F.col("end_ms").alias("t")).agg(F.min("group_id").alias("gid"))
    kind = groups.schema["group_id"].dataType
    asked = markers.filter("at_ms is not null").select(*keys, F.col("at_ms").alias("t")).distinct()
    rows = ends.select(*keys, "t", F.lit(1).alias("side"), "gid").unionByName(
        asked.select(*keys, "t", F.lit(0).alias("side"), F.lit(None).cast(kind).alias("gid"))
    )
    scanned = chunk_scan(
        rows, keys, ["t", "side"], chunk_of(F.col("t"), span),
        local=[{"_l": lambda w: F.min("gid").over(_upto(w))}],
        summary={"_t": F.min("gid")},
        carry=[{"_c": lambda w: F.min("_t").over(_before(w))}],
        descending=True,
    )
    target = scanned.filter("side = 0").select(*keys, F.col("t").alias("at_ms"), F.least("_l", "_c").alias("group_id"))
    placed = markers.filter("at_ms is not null").join(target, [*keys, "at_ms"], "left")
    starts = groups.select(*keys, "group_id", "start_ms")
    placed = placed.join(starts, [*keys, "group_id"], "left")
    placement = F.when(F.col("group_id").isNull(), "tail").when(F.col("at_ms") < F.col("start_ms"), "before").otherwise("inside")
    return placed.select(*keys, "marker_no", "at_ms", "group_id", placement.alias("placement"))


def _ms(text: Column) -> Column:
    return F.unix_millis(non_empty(text).try_cast("timestamp"))


def merged_ids(groups: DataFrame, keys: list[str] = SESSION, span: int = LINE_SPAN) -> DataFrame:
    """(keys, group_id, merged_id): the group of :func:`merge_adjacent` that each group of ``groups`` becomes part of."""
    runs = number_runs(groups.select(*keys, "group_id", "kind"), keys, "group_id", chunk_of(F.col("group_id"), span), F.col("kind"), F.col("kind") != "assistant")
    first = runs.groupBy(*keys, "run_no").agg(F.min("group_id").alias("merged_id"))
    return runs.join(first, [*keys, "run_no"]).select(*keys, "group_id", "merged_id")


def place_in_steps(placed: DataFrame, groups: DataFrame, pairs: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Where markers inside an assistant group stand among its tool pairs.

    ``placed`` is the result of :func:`place_markers`, ``groups`` has keys, group_id, kind and start_at, ``pairs`` are those of
    :func:`pair_tools` under the group_id of ``groups``. A marker goes to the first pair, in order of their calls, that
    ends at or after it: ``step_side`` is ``before`` or ``after`` the pair (step_seq, step_pos), or ``end`` behind all pairs.
    A pair without time counts as standing at the start of its group. This is the as-of scan of
    :func:`place_markers` once more, with the pairs as groups and the groups as keys.
    """
    of = [*keys, "group_id"]
    talks = groups.filter("kind = 'assistant'").select(*of, _ms(F.col("start_at")).alias("_start"))
    inside = placed.filter("placement = 'inside'").join(talks.select(*of), of, "left_semi")
    call, answer = _ms(F.col("use_at")), _ms(F.col("result_at"))
    start = F.coalesce(F.least(call, answer), F.col("_start"))
    end = F.coalesce(F.greatest(call, answer), start)
    step = F.struct(F.coalesce("use_seq", "result_seq").alias("seq"), F.col("pos").cast("int").alias("pos"))
    steps = pairs.join(talks, of).select(*of, step.alias("step"), start.alias("start_ms"), end.alias("end_ms"))
    wanted = inside.join(steps.select(*of).distinct(), of, "left_semi")
    own = [*keys, "_group"]
    found = place_markers(
        steps.withColumnRenamed("group_id", "_group").withColumnRenamed("step", "group_id"),
        wanted.select(*keys, F.col("group_id").alias("_group"), "marker_no", "at_ms"), own, span,
    )
    side = F.when(F.col("placement") == "tail", "end").when(F.col("placement") == "inside", "after").otherwise(F.col("placement"))
    found = found.select(*keys, "marker_no", F.col("group_id.seq").alias("step_seq"), F.col("group_id.pos").alias("step_pos"), side.alias("step_side"))
    return inside.select(*keys, "marker_no", "at_ms", "group_id").join(found, [*keys, "marker_no"], "left").withColumn("step_side", F.coalesce("step_side", F.lit("end")))


def filter_tool(groups: DataFrame, uses: DataFrame, tool: str, keys: list[str] = SESSION) -> DataFrame:
    """Groups that use a tool, and all user groups; system groups go."""
    using = uses.filter(F.col("tool_name") == tool).select(*keys, "group_id").distinct().withColumn("_uses", F.lit(True))
    marked = groups.join(using, [*keys, "group_id"], "left")
    return marked.filter("kind = 'user' or (kind = 'assistant' and _uses)").drop("_uses")
