"""Queries over turns, sessions, prices, rollups and charts, with their reference answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.models import model_display, normalise_model
from logloom.operators import charts, pricing, rollups, sessions, turns as turn_ops
from logloom.operators.pricing import COST, MICRO, TOKENS, costs_rounded, match_used, usd_rounded
from logloom.plans import sqlparts as q
from logloom.session import cut_lineage
from logloom.sources import tables as t
from logloom.sources.prices import default_prices

BASE = t.BASE_DATE


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return pricing.match_prices(t.turns(spark, d), default_prices(spark))


def _usage(spark: SparkSession, d: str, after: str | None = None) -> DataFrame:
    return rollups.model_usage(t.turns(spark, d), default_prices(spark), after)


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_summary(
        t.facts(spark, d), t.turns(spark, d), t.turn_tools(spark, d), default_prices(spark)
    )


def _base_turns(spark: SparkSession, d: str) -> DataFrame:
    return t.turns(spark, d).filter(F.substring("timestamp", 1, 10) <= BASE)


def _drop_micro(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in MICRO], *costs_rounded(digits))


# --- queries --------------------------------------------------------------------------------


def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    return pricing.cost_by_model(_usage(spark, d))


def price_match(spark: SparkSession, d: str) -> DataFrame:
    turns = t.turns(spark, d)
    matched = pricing.match_prices(turns, default_prices(spark)).select("model", "price_key", F.col("input_price").cast("double").alias("input_price"))
    return turns.select("model").distinct().join(matched, "model", "left").withColumn("normalised", normalise_model(F.col("model")))


def turn_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of every single turn in all modes."""
    rows = t.turns(spark, d).select("turn_key", "model", *TOKENS)
    return _drop_micro(pricing.with_costs(rows, pricing.bounded(_matched(spark, d)))).select("turn_key", "model", *COST)


def cost_mode_pick(spark: SparkSession, d: str) -> DataFrame:
    u = _usage(spark, d)
    return u.select(
        "model", usd_rounded(pricing.pick_cost(None)).alias("default_cost"),
        usd_rounded(pricing.pick_cost("api")).alias("api_cost"),
        usd_rounded(pricing.pick_cost("unknown")).alias("fallback_cost"),
    )


def cache_savings(spark: SparkSession, d: str) -> DataFrame:
    out = pricing.cache_savings(_usage(spark, d).drop(*MICRO), default_prices(spark))
    return out.select("cache_read_tokens", usd_rounded(F.col("micro_saved")).alias("saved"))


def cost_by_project(spark: SparkSession, d: str) -> DataFrame:
    return pricing.cost_by_project(_projects(spark, d), "api")


def price_reference(spark: SparkSession, d: str) -> DataFrame:
    out = pricing.price_reference(default_prices(spark), t.turns(spark, d))
    return out.select("model", "provider", *[F.col(c).cast("double").alias(c) for c in ("input_price", "output_price", "cache_write_price", "cache_read_price")])


def daily_cost_wide(spark: SparkSession, d: str) -> DataFrame:
    daily = rollups.daily_model(t.turns(spark, d), default_prices(spark))
    return pricing.daily_cost_wide(daily, "api", ["Haiku", "Opus", "Sonnet"])


def allocated_daily_cost(spark: SparkSession, d: str) -> DataFrame:
    turns = _base_turns(spark, d)
    base = rollups.daily_model(turns, default_prices(spark)).select("date", "model", "tokens")
    return _drop_micro(pricing.allocate_costs(base, _usage(spark, d)), 2)


def collapsed_turns(spark: SparkSession, d: str) -> DataFrame:
    out = turn_ops.collapse_turns(t.snapshots(spark, d))
    return out.drop("session_id", "recovered_cache_write")


def recovered_cache_writes(spark: SparkSession, d: str) -> DataFrame:
    return turn_ops.collapse_turns(t.snapshots(spark, d)).select(
        "file_path", "turn_key", "has_usage", "cache_write_tokens", "recovered_cache_write"
    )


def distinct_turn_tools(spark: SparkSession, d: str) -> DataFrame:
    return turn_ops.turn_tools(t.snapshot_tools(spark, d)).select("file_path", "turn_key", "tool_id", "tool_name")


def merged_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = t.snapshots(spark, d).withColumn("message_id", F.when(F.col("seq") % 5 != 0, F.col("turn_key")))
    return _drop_micro(turn_ops.merge_usage(rows, default_prices(spark), ["session_id"]))


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return _drop_micro(_summary(spark, d))


def session_span(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_span(t.facts(spark, d))


def session_model_list(spark: SparkSession, d: str) -> DataFrame:
    out = sessions.session_models(t.turns(spark, d))
    return out.select("session_id", "model", model_display(F.col("model")).alias("display_name"), F.col("first_turn.first_seq").alias("first_seq"))


def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    return sessions.tool_usage(t.turn_tools(spark, d))


def compaction_stats(spark: SparkSession, d: str) -> DataFrame:
    return sessions.compaction_stats(t.facts(spark, d))


def compaction_times(spark: SparkSession, d: str) -> DataFrame:
    return sessions.compaction_times(t.facts(spark, d))


def _projects(spark: SparkSession, d: str) -> DataFrame:
    return sessions.project_summary(_summary(spark, d))


def project_summary(spark: SparkSession, d: str) -> DataFrame:
    return _drop_micro(_projects(spark, d))


def project_models(spark: SparkSession, d: str) -> DataFrame:
    return sessions.project_models(t.turns(spark, d))


def project_names(spark: SparkSession, d: str) -> DataFrame:
    return sessions.project_names(t.facts(spark, d))


def session_page(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.session_span(t.facts(spark, d)).select("project_id", "session_id", "started_at")
    return sessions.list_sessions(rows, limit=50, offset=20)


def project_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.session_span(t.facts(spark, d)).select("project_id", "session_id", "started_at")
    return sessions.list_sessions(rows, project="8")


def text_search(spark: SparkSession, d: str) -> DataFrame:
    m = t.messages(spark, d)
    begun = m.groupBy("session_id").agg(F.count("*").alias("message_count")).withColumns(
        {"project_id": F.lit("p"), "started_at": F.lpad("session_id", 12, "0")}
    )
    texts = m.filter(F.col("role").isin("user", "assistant")).select("session_id", F.col("content").alias("text"))
    return sessions.search_sessions(texts, begun, "The By")


def project_detail(spark: SparkSession, d: str) -> DataFrame:
    return _drop_micro(sessions.project_detail(_summary(spark, d)))


def top_project_tools(spark: SparkSession, d: str) -> DataFrame:
    return sessions.top_project_tools(sessions.tool_usage(t.turn_tools(spark, d)))


def top_session_tools(spark: SparkSession, d: str) -> DataFrame:
    return sessions.top_session_tools(sessions.tool_usage(t.turn_tools(spark, d)), 10)


def daily_activity(spark: SparkSession, d: str) -> DataFrame:
    return rollups.daily_activity(t.facts(spark, d), t.turns(spark, d))


def daily_activity_delta(spark: SparkSession, d: str) -> DataFrame:
    return rollups.daily_activity(t.facts(spark, d), t.turns(spark, d), BASE)


def daily_model(spark: SparkSession, d: str) -> DataFrame:
    return _drop_micro(rollups.daily_model(t.turns(spark, d), default_prices(spark)))


def model_usage(spark: SparkSession, d: str) -> DataFrame:
    return _drop_micro(_usage(spark, d))


def hour_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.hour_counts(t.turns(spark, d))


def totals(spark: SparkSession, d: str) -> DataFrame:
    return _drop_micro(rollups.totals(t.facts(spark, d), t.turns(spark, d), default_prices(spark)))


def merged_model_usage(spark: SparkSession, d: str) -> DataFrame:
    base = rollups.model_usage(_base_turns(spark, d), default_prices(spark))
    return _drop_micro(rollups.merge_rollup(base, _usage(spark, d, BASE), ["model"]))


def merged_daily_activity(spark: SparkSession, d: str) -> DataFrame:
    facts = t.facts(spark, d)
    old = facts.filter(F.substring("timestamp", 1, 10) <= BASE)
    base = rollups.daily_activity(old, _base_turns(spark, d))
    return rollups.merge_rollup(base, rollups.daily_activity(facts, t.turns(spark, d), BASE), ["date"])


def merged_daily_models(spark: SparkSession, d: str) -> DataFrame:
    prices = default_prices(spark)
    turns = t.turns(spark, d)
    matched = match_used(turns, prices)
    base = rollups.daily_tokens(_base_turns(spark, d))
    usage = rollups.model_usage(turns, prices, matched=matched)
    delta = rollups.daily_model(turns, prices, BASE, matched)
    return _drop_micro(rollups.merge_daily_models(base, delta, usage), 2)


def _all_rollups(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return rollups.all_rollups(t.facts(spark, d), t.turns(spark, d), default_prices(spark))


def rolled_activity(spark: SparkSession, d: str) -> DataFrame:
    return _all_rollups(spark, d)["activity"]


def rolled_daily_models(spark: SparkSession, d: str) -> DataFrame:
    return _drop_micro(_all_rollups(spark, d)["daily_models"])


def rolled_totals(spark: SparkSession, d: str) -> DataFrame:
    return _drop_micro(_all_rollups(spark, d)["totals"])


def rolled_hours(spark: SparkSession, d: str) -> DataFrame:
    return _all_rollups(spark, d)["hours"]


def rolled_models(spark: SparkSession, d: str) -> DataFrame:
    return _drop_micro(_all_rollups(spark, d)["models"])


def merged_hours(spark: SparkSession, d: str) -> DataFrame:
    base = rollups.hour_counts(_base_turns(spark, d))
    return rollups.merge_rollup(base, rollups.hour_counts(t.turns(spark, d), BASE), ["hour"])


def headline(spark: SparkSession, d: str) -> DataFrame:
    from logloom.plans.dashboard import headline_stats

    out = headline_stats(_summary(spark, d), rollups.totals(t.facts(spark, d), t.turns(spark, d), default_prices(spark)))
    return _drop_micro(out)


def merged_headline(spark: SparkSession, d: str) -> DataFrame:
    """The headline where logs up to the base date are gone and only their rollup is left."""
    from logloom.plans.dashboard import headline_stats

    prices, old = default_prices(spark), F.substring("session_id", -10, 10) <= BASE
    facts, turns, summary = t.facts(spark, d), t.turns(spark, d), cut_lineage(_summary(spark, d))
    ended = rollups.longest_session(summary.filter(old)).withColumnRenamed("first_started_at", "first_session_date")
    base_totals = rollups.totals(facts.filter(old), turns.filter(old), prices).unionByName(ended, allowMissingColumns=True)  # one row each
    base_totals = cut_lineage(base_totals.agg(*[F.max(c).alias(c) for c in base_totals.columns]))
    usage = rollups.model_usage(turns.filter(old), prices).drop(*MICRO)
    usage = rollups.merge_rollup(pricing.price_usage(usage, prices), rollups.model_usage(turns.filter(~old), prices), ["model"])
    both = rollups.merged_totals(base_totals, usage, rollups.totals(facts.filter(~old), turns.filter(~old), prices))
    return _drop_micro(headline_stats(summary.filter(~old), both, base_totals))


def activity_heatmap(spark: SparkSession, d: str) -> DataFrame:
    daily = rollups.daily_activity(t.facts(spark, d), t.turns(spark, d))
    return charts.activity_heatmap(daily, F.max(F.col("date").cast("date")))


def peak_hours(spark: SparkSession, d: str) -> DataFrame:
    return charts.peak_hours(rollups.hour_counts(t.turns(spark, d)))


def usage_over_time(spark: SparkSession, d: str) -> DataFrame:
    return charts.usage_over_time(rollups.daily_activity(t.facts(spark, d), t.turns(spark, d)), "tool_calls")


def model_share(spark: SparkSession, d: str) -> DataFrame:
    return charts.model_share(_usage(spark, d))


def usage_composition(spark: SparkSession, d: str) -> DataFrame:
    from logloom.operators.context import usage_snapshot

    return usage_snapshot(sessions.session_usage(t.turns(spark, d)), ["project_id", "session_id"])


QUERIES = {
    f.__name__: f
    for f in (
        cost_by_model, price_match, turn_costs, cost_mode_pick, cache_savings, cost_by_project, price_reference,
        daily_cost_wide, allocated_daily_cost, collapsed_turns, recovered_cache_writes, distinct_turn_tools,
        merged_usage, session_summary, session_span, session_model_list, tool_usage, compaction_stats,
        compaction_times, project_summary, project_models, project_names, session_page, project_sessions,
        text_search, project_detail, top_project_tools, top_session_tools, daily_activity, daily_activity_delta,
        daily_model, model_usage, hour_counts, totals, merged_model_usage, merged_daily_activity,
        merged_daily_models, merged_hours, rolled_activity, rolled_daily_models, rolled_totals, rolled_hours, rolled_models, headline, merged_headline, activity_heatmap, peak_hours, usage_over_time, model_share,
        usage_composition,
    )
}

# --- reference answers ----------------------------------------------------------------------

DISPLAY = (
    "case when contains(lower(model),'synthetic') then 'Synthetic' when contains(lower(model),'opus') then 'Opus' "
    "when contains(lower(model),'sonnet') then 'Sonnet' when contains(lower(model),'haiku') then 'Haiku' else model end"
)
TOKEN_COLS = "it input_tokens, ot output_tokens, cw cache_write_tokens, cr cache_read_tokens"

SESSION_USAGE = (
    "su as (select s.*, " + q.micros() + " from (select project_id, session_id, model, count(*) filter (where top_level) n, "
    "sum(it)::bigint it, sum(ot)::bigint ot, sum(cw)::bigint cw, sum(cr)::bigint cr from turns group by all) s left join pm using (model))"
)
SPAN = """span as (
  select *, greatest(last_ts, sub_ts) ended_at,
    coalesce(epoch_ms(cast(greatest(last_ts, sub_ts) as timestamp)) - epoch_ms(cast(started_at as timestamp)), 0) duration_ms
  from (select project_id, session_id,
      count(*) filter (where top_level and "type"='user') user_count,
      arg_min(tstamp, seq) filter (where top_level and tstamp is not null) started_at,
      arg_max(tstamp, seq) filter (where top_level and tstamp is not null) last_ts,
      max(tstamp) filter (where not top_level) sub_ts,
      arg_min(git_branch, seq) filter (where top_level and git_branch is not null) git_branch,
      arg_min(cwd, seq) filter (where top_level and cwd is not null) cwd,
      arg_min(version, seq) filter (where top_level and version is not null) version
    from facts group by all having count(*) filter (where top_level) > 0))"""
SUMMARY = """summary as (
  select s.project_id, s.session_id, user_count, started_at, ended_at, duration_ms, git_branch, cwd, version,
    coalesce(assistant_count,0) assistant_count, coalesce(tool_count,0) tool_count, coalesce(model_count,0) model_count,
    coalesce(compactions,0) compactions, coalesce(microcompactions,0) microcompactions, coalesce(saved,0)::bigint tokens_saved,
    coalesce(u.it,0)::bigint it, coalesce(u.ot,0)::bigint ot, coalesce(u.cw,0)::bigint cw, coalesce(u.cr,0)::bigint cr,
    coalesce(micro_api,0) micro_api, coalesce(micro_conservative,0) micro_conservative, coalesce(micro_subscription,0) micro_subscription,
    coalesce(m.model,'unknown') model, user_count + coalesce(assistant_count,0) message_count
  from span s
  left join (select project_id, session_id, sum(n)::bigint assistant_count, sum(it) it, sum(ot) ot, sum(cw) cw, sum(cr) cr,
      count(model) model_count, """ + q.sum_micros() + """ from su group by all) u using (project_id, session_id)
  left join (select project_id, session_id, first(model order by top_level desc, file_path, event_id) model from turns group by all) m using (project_id, session_id)
  left join (select project_id, session_id, count(*) tool_count from tools group by all) c using (project_id, session_id)
  left join (select project_id, session_id, count(*) filter (where is_full) compactions, count(*) filter (where is_micro) microcompactions,
      sum(saved) saved from facts where top_level group by all) k using (project_id, session_id))"""
SUMMARY_CTES = ["ev", "turns", "tools", "facts", "prices", "scored", "pm"]
PROJECTS = """projects as (
  select project_id, count(*) session_count, sum(message_count)::bigint message_count, sum(it+ot+cw+cr)::bigint total_tokens,
    sum(it)::bigint it, sum(ot)::bigint ot, sum(cw)::bigint cw, sum(cr)::bigint cr, """ + q.sum_micros() + """,
    max(ended_at) last_record_at from summary group by project_id)"""
SDAYS = """sdays as (
  select project_id, session_id, first(d order by kind, f, seq) d from (
    select project_id, session_id, substr(tstamp,1,10) d, 0 kind, '' f, seq from facts where top_level and "type"='user' and tstamp is not null {0}
    union all select project_id, session_id, d, case when top_level then 1 else 2 end, file_path, event_id from turns where true {1}) group by all)"""
DAILY = """daily as (
  select d, sum(m)::bigint message_count, sum(s)::bigint session_count, sum(t)::bigint tool_call_count from (
    select substr(tstamp,1,10) d, 1 m, 0 s, 0 t from facts where top_level and "type"='user' and tstamp is not null {0}
    union all select d, 1, 0, n_tools from turns where top_level {1}
    union all select d, 0, 1, 0 from sdays) group by d having sum(m) > 0)"""


def _daily(after: str | None = None) -> tuple[str, str]:
    a = f"and substr(tstamp,1,10) > '{after}'" if after else ""
    b = f"and d > '{after}'" if after else ""
    return SDAYS.format(a, b), DAILY.format(a, b)


def _daily_upto(cut: str) -> tuple[str, str]:
    a, b = f"and substr(tstamp,1,10) <= '{cut}'", f"and d <= '{cut}'"
    return SDAYS.format(a, b), DAILY.format(a, b)


DM = (
    "dm as (select x.*, " + q.micros() + " from (select d, model, sum(it)::bigint it, sum(ot)::bigint ot, sum(cw)::bigint cw, "
    "sum(cr)::bigint cr, sum(it+ot+cw+cr)::bigint tokens from turns group by d, model) x left join pm using (model))"
)
ALLOC = "alloc as (select d, model, tokens, " + ", ".join(
    f"cast(round(cast(tokens as double) * (cast(u.micro_{m} as double) / cast(u.it+u.ot+u.cw+u.cr as double)), 4) as decimal(38,10)) micro_{m}"
    for m in q.SHARES
) + f" from (select d, model, tokens from dm where d <= '{BASE}') b join usage u using (model))"
TURN_KEYS = "project_id, session_id, file_path, turn_key"
COLLAPSED = f"""opened as (
  select {TURN_KEYS}, min(seq) f from snaps where used and not thinking group by all),
held as (
  select {TURN_KEYS}, arg_max(cw, s.seq) held from snaps s join opened o using ({TURN_KEYS})
  where used and thinking and s.seq < o.f group by all),
ending as (
  select {TURN_KEYS}, s.visible and s.ends ok from snaps s join opened o using ({TURN_KEYS}) where s.seq = o.f),
collapsed as (
  select g.*, case when ok then coalesce(held,0) else 0 end extra from (
    select {TURN_KEYS}, min(seq) first_seq, bool_or(top_level) top_level,
      coalesce(arg_max(tstamp, seq) filter (where tstamp is not null),'') tstamp,
      coalesce(arg_max(model, seq) filter (where model is not null),'') model, bool_or(used) has_usage,
      arg_max(it, seq) filter (where used) it, arg_max(ot, seq) filter (where used) ot,
      arg_max(cw, seq) filter (where used) cw, arg_max(cr, seq) filter (where used) cr, count(*) snapshots
    from snaps group by all) g left join held using ({TURN_KEYS}) left join ending using ({TURN_KEYS}))"""
MERGED = """ranked as (
  select session_id, coalesce(case when seq % 5 <> 0 then turn_key end, '#'||seq) ident, min(seq) first_seq,
    arg_max({'m': model, 't': tier, 'it': it, 'ot': ot, 'cw': cw, 'cr': cr, 'c5': c5, 'c1': c1}, seq) v from snaps where used group by all),
per as (select x.*, """ + q.micros() + """ from (
    select session_id, v.m model, sum(v.it)::bigint it, sum(v.ot)::bigint ot, sum(v.cw)::bigint cw, sum(v.cr)::bigint cr,
      sum(v.c5)::bigint c5, sum(v.c1)::bigint c1, count(*) n from ranked group by all) x left join pm on pm.model = x.model),
tiers as (select session_id, arg_max(v.t, first_seq) tier from ranked group by all)"""

_all_daily = _daily()

ORACLE = {
    "cost_by_model": q.with_(q.PRICED, f"select model, {DISPLAY} display_name, {TOKEN_COLS}, {q.usd('micro_subscription')} cost from usage", q.USAGE),
    "price_match": q.with_(q.PRICED, "select i.model, price_key, cast(pi as double) input_price, id normalised from ids i left join pm using (model)"),
    "turn_costs": q.with_(q.PRICED, f"select turn_key, model, {q.costs()} from (select cast(event_id as varchar) turn_key, turns.model, {q.micros()} from turns left join pm using (model))"),
    "cost_mode_pick": q.with_(q.PRICED, f"select model, {q.usd('micro_subscription')} default_cost, {q.usd('micro_api')} api_cost, {q.usd('micro_subscription')} fallback_cost from usage", q.USAGE),
    "cache_savings": q.with_(q.PRICED, f"select sum(cr)::bigint cache_read_tokens, {q.usd('sum(cast(cr as decimal(18,0)) * (pi - pr))')} saved from usage left join pm using (model)", q.USAGE),
    "cost_by_project": q.with_(SUMMARY_CTES, f"select project_id, {q.usd('micro_api', 2)} cost from projects where micro_api > 0 order by micro_api desc, project_id limit 10", SESSION_USAGE, SPAN, SUMMARY, PROJECTS),
    "price_reference": q.with_(q.PRICED, "select price_key model, provider, cast(pi as double) input_price, cast(po as double) output_price, cast(pw as double) cache_write_price, cast(pr as double) cache_read_price from prices where price_key in (select price_key from pm)"),
    "daily_cost_wide": q.with_(q.PRICED, "select d as date, " + ", ".join(
        f"{q.usd(f'coalesce(sum(micro_api) filter (where n = {chr(39)}{n}{chr(39)}), 0)', 2)} as \"{n}\"" for n in ("Haiku", "Opus", "Sonnet")
    ) + f", {q.usd(f'coalesce(sum(micro_api) filter (where n not in ({chr(39)}Haiku{chr(39)}, {chr(39)}Opus{chr(39)}, {chr(39)}Sonnet{chr(39)}) or n is null), 0)', 2)} as other" + f" from (select *, {DISPLAY} n from dm) group by d", DM),
    "allocated_daily_cost": q.with_(q.PRICED, "select d as date, model, tokens, " + ", ".join(f"{q.usd(f'micro_{m}', 2)} cost_{m}" for m in q.SHARES) + " from alloc", q.USAGE, DM, ALLOC),
    "collapsed_turns": q.with_(["ev", "snaps"], "select project_id, file_path, turn_key, first_seq, top_level, tstamp as timestamp, model, has_usage, it input_tokens, ot output_tokens, cw + extra cache_write_tokens, cr cache_read_tokens, snapshots from collapsed", COLLAPSED),
    "recovered_cache_writes": q.with_(["ev", "snaps"], "select file_path, turn_key, has_usage, cw + extra cache_write_tokens, extra recovered_cache_write from collapsed", COLLAPSED),
    "distinct_turn_tools": q.with_(["ev", "snaps"], "select file_path, turn_key, 't'||(k % 4) tool_id, arg_max((['Bash','Edit','Read','Grep','Write'])[(k % 5)+1], seq) tool_name from snaps where visible and top_level group by all"),
    "merged_usage": q.with_(["ev", "turns", "snaps", "prices", "scored", "pm"], f"select session_id, {q.SUM_TOKENS}, sum(c5)::bigint cache_5m_tokens, sum(c1)::bigint cache_1h_tokens, sum(n)::bigint messages, any_value(tier) service_tier, {q.sum_costs()} from per join tiers using (session_id) group by session_id", MERGED),
    "session_summary": q.with_(SUMMARY_CTES, f"select * exclude (it, ot, cw, cr, micro_api, micro_conservative, micro_subscription), {TOKEN_COLS}, {q.costs()} from summary", SESSION_USAGE, SPAN, SUMMARY),
    "session_span": q.with_(["ev", "facts"], "select project_id, session_id, user_count, started_at, ended_at, duration_ms, git_branch, cwd, version from span", SPAN),
    "session_model_list": q.with_(["ev", "turns"], f"select session_id, model, {DISPLAY} display_name, first(event_id order by top_level desc, file_path, event_id) first_seq from turns group by session_id, model"),
    "tool_usage": q.with_(["ev", "tools"], "select project_id, session_id, tool_name, count(*) calls from tools group by all"),
    "compaction_stats": q.with_(["ev", "facts"], "select project_id, session_id, count(*) filter (where is_full) compactions, count(*) filter (where is_micro) microcompactions, sum(saved)::bigint tokens_saved from facts where top_level group by all"),
    "compaction_times": q.with_(["ev", "facts"], "select project_id, session_id, seq, tstamp as timestamp from facts where top_level and (is_full or is_micro) and tstamp is not null"),
    "project_summary": q.with_(SUMMARY_CTES, f"select project_id, session_count, message_count, total_tokens, {TOKEN_COLS}, last_record_at, last_record_at last_active, {q.costs()} from projects", SESSION_USAGE, SPAN, SUMMARY, PROJECTS),
    "project_models": q.with_(["ev", "turns"], f"select distinct project_id, {DISPLAY} display_name from turns"),
    "project_names": q.with_(["ev", "facts"], "select project_id, coalesce(list_last(string_split(cwd,'/')), list_last(string_split(replace(project_id,'-','/'),'/'))) project_name, coalesce(cwd, replace(project_id,'-','/')) project_path from (select project_id, first(cwd order by file_path) cwd from (select project_id, file_path, arg_min(cwd, seq) filter (where cwd is not null) cwd from facts where top_level group by all) group by project_id)"),
    "session_page": q.with_(["ev", "facts"], "select project_id, session_id, started_at from span order by started_at desc nulls last, session_id, project_id limit 50 offset 20", SPAN),
    "project_sessions": q.with_(["ev", "facts"], "select project_id, session_id, started_at from span where project_id = '8'", SPAN),
    "text_search": "select cast(conv_id as varchar) session_id, count(*) message_count, 'p' project_id, lpad(cast(conv_id as varchar), 12, '0') started_at from conversations where conv_id in (select conv_id from conversations where role in ('user','assistant') and contains(lower(text), 'the by')) group by conv_id order by started_at desc limit 50",
    "project_detail": q.with_(SUMMARY_CTES, f"select project_id, count(*) session_count, sum(message_count)::bigint message_count, sum(tool_count)::bigint tool_count, {q.sum_costs()} from summary group by project_id", SESSION_USAGE, SPAN, SUMMARY),
    "top_project_tools": q.with_(["ev", "tools"], "select * from (select *, row_number() over (partition by project_id order by calls desc, tool_name)::int rank from (select project_id, tool_name, count(*) calls from tools group by all)) where rank <= 8"),
    "top_session_tools": q.with_(["ev", "tools"], "select * from (select *, row_number() over (partition by project_id, session_id order by calls desc, tool_name)::int rank, cast(calls as double) / cast(max(calls) over (partition by project_id, session_id) as double) share_of_max from (select project_id, session_id, tool_name, count(*) calls from tools group by all)) where rank <= 10"),
    "daily_activity": q.with_(["ev", "turns", "facts"], "select d as date, message_count, session_count, tool_call_count from daily", *_all_daily),
    "daily_activity_delta": q.with_(["ev", "turns", "facts"], "select d as date, message_count, session_count, tool_call_count from daily", *_daily(BASE)),
    "daily_model": q.with_(q.PRICED, f"select d as date, model, tokens, {q.costs()} from dm", DM),
    "model_usage": q.with_(q.PRICED, f"select model, {TOKEN_COLS}, {q.costs()} from usage", q.USAGE),
    "hour_counts": "select cast(hour(ts) as int) as hour, count(*) turn_count from events group by 1",
    "totals": q.with_(["ev", "turns", "facts", "prices", "scored", "pm"], f"""select (select count(*) from sdays) session_count,
      (select count(*) from facts where top_level and "type"='user' and tstamp is not null) + (select count(*) from turns where top_level) message_count,
      (select sum(it+ot+cw+cr)::bigint from turns) total_tokens, {q.sum_costs()} from usage""", q.USAGE, _all_daily[0]),
    "merged_daily_models": q.with_(q.PRICED, "select d as date, model, sum(tokens)::bigint tokens, " + ", ".join(f"{q.usd(f'sum(micro_{m})', 2)} cost_{m}" for m in q.SHARES) + f" from (select d, model, tokens, micro_api, micro_conservative, micro_subscription from alloc union all select d, model, tokens, micro_api, micro_conservative, micro_subscription from dm where d > '{BASE}') group by d, model", q.USAGE, DM, ALLOC),
    "merged_daily_activity": q.with_(["ev", "turns", "facts"], "select d as date, sum(message_count)::bigint message_count, sum(session_count)::bigint session_count, sum(tool_call_count)::bigint tool_call_count from (select * from daily_old union all select * from daily) group by d",
        *[x.replace("sdays", "sdays_old").replace("daily as", "daily_old as") for x in _daily_upto(BASE)], *_daily(BASE)),
    "headline": q.with_(SUMMARY_CTES, f"""select (select count(*) from sdays) session_count,
      (select count(*) from facts where top_level and "type"='user' and tstamp is not null) + (select count(*) from turns where top_level) message_count,
      (select sum(it+ot+cw+cr)::bigint from summary) total_tokens, (select count(distinct project_id) from summary) project_count,
      min(started_at) first_started_at,
      first(session_id order by duration_ms desc, session_id desc) longest_session_id, max(duration_ms) longest_duration_ms,
      first(message_count order by duration_ms desc, session_id desc) longest_message_count, {q.sum_costs()} from summary""", SESSION_USAGE, SPAN, SUMMARY, _all_daily[0]),
    "merged_headline": q.with_(SUMMARY_CTES, f"""select session_count, message_count, total_tokens, project_count, first_started_at, longest_session_id, longest_duration_ms, longest_message_count, cost_api, cost_conservative, cost_subscription from (
      select (select count(*) from sdays) session_count,
      (select count(*) from facts where top_level and "type"='user' and tstamp is not null) + (select count(*) from turns where top_level) message_count,
      min(started_at) first_started_at, first(session_id order by duration_ms desc, session_id desc) longest_session_id, max(duration_ms) longest_duration_ms,
      first(message_count order by duration_ms desc, session_id desc) longest_message_count from summary),
      (select sum(it+ot+cw+cr)::bigint total_tokens, count(distinct project_id) project_count, {q.sum_costs()} from summary where right(session_id, 10) > '{BASE}')""", SESSION_USAGE, SPAN, SUMMARY, _all_daily[0]),
    "activity_heatmap": q.with_(["ev", "turns", "facts"], """select strftime(day,'%Y-%m-%d') as date, cast(dayofweek(day) + 1 as int) weekday, coalesce(message_count,0)::bigint message_count,
      case when coalesce(message_count,0) = 0 then 0 when message_count / top < 0.25 then 1 when message_count / top < 0.5 then 2 when message_count / top < 0.75 then 3 else 4 end as level,
      day > today is_future
      from (select max(d)::date today, greatest(max(message_count),1)::double top from daily) b,
        unnest(generate_series(0, 167)) g(i), lateral (select (today - 161 - cast(dayofweek(today - 161) as int) + cast(i as int))::date as day)
      left join daily on daily.d = strftime(day,'%Y-%m-%d')""", *_all_daily),
    "peak_hours": "select cast(h as int) as hour, case when h = 0 then '12a' when h < 12 then h||'a' when h = 12 then '12p' else (h-12)||'p' end as label, coalesce(n,0)::bigint turn_count from range(24) r(h) left join (select hour(ts) hh, count(*) n from events group by 1) on hh = h",
    "usage_over_time": q.with_(["ev", "turns", "facts"], "select d as date, strftime(d::date,'%b %-d') as label, tool_call_count as value from daily", *_all_daily),
    "model_share": q.with_(q.PRICED, f"select model, {DISPLAY} display_name, it+ot+cw+cr tokens, {q.usd('micro_subscription')} cost, ((it+ot+cw+cr)*200 + tot) // (tot*2) percent from usage, (select sum(it+ot+cw+cr)::bigint tot from turns)", q.USAGE),
    "usage_composition": q.with_(["ev", "turns"], """select project_id, session_id, segment, cast(v as bigint) as tokens, cast(total as bigint) as total from (
      select project_id, session_id, unnest(['input','cache-read','output','cache-write']) segment, unnest([it,cr,ot,cw]) v, it+ot+cw+cr total from (select project_id, session_id, sum(it) it, sum(ot) ot, sum(cw) cw, sum(cr) cr from turns group by all)) where v > 0"""),
}
ORACLE["merged_model_usage"] = ORACLE["model_usage"]
ORACLE["merged_hours"] = ORACLE["hour_counts"]

# The rollups of one pass equal those of their own.
ORACLE |= {f"rolled_{new}": ORACLE[old] for new, old in (("activity", "daily_activity"), ("daily_models", "daily_model"), ("totals", "totals"), ("hours", "hour_counts"), ("models", "model_usage"))}
