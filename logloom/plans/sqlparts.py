"""SQL building blocks of the reference answers (DuckDB dialect) over the same tables."""

from __future__ import annotations

from logloom.sources.price_list import PRICE_LINES


def _price_values() -> str:
    rows = []
    for i, line in enumerate(x for x in PRICE_LINES.split("\n") if x):
        m, p, a, b, c, d = line.split(" ")
        rows.append(f"('{m}','{p}',{a}::decimal(12,8),{b}::decimal(12,8),{c}::decimal(12,8),{d}::decimal(12,8),{i})")
    return ",".join(rows)


CTE = {
    "ev": """ev as (
  select event_id, ts, user_id, event_type, value, cast(json_extract_string(props,'$.k') as bigint) k,
    cast(user_id as varchar) project_id, cast(user_id as varchar)||'-'||strftime(ts,'%Y-%m-%d') session_id,
    (event_id % 10) <> 0 top_level,
    cast(user_id as varchar)||'-'||strftime(ts,'%Y-%m-%d')||(case when (event_id % 10) <> 0 then '.jsonl' else '/subagents/a.jsonl' end) file_path,
    strftime(ts,'%Y-%m-%dT%H:%M:%S.%g')||'Z' as tstamp, epoch_us(ts) micros,
    case event_type when 'view' then 'claude-opus-4-7' when 'click' then 'claude-sonnet-4-6-20260504'
      when 'purchase' then 'claude-haiku-4-5-20251001' when 'signup' then 'claude-opus-4' else 'unlisted-model' end model
  from events)""",
    "turns": """turns as (
  select project_id, session_id, file_path, event_id, top_level, tstamp, strftime(ts,'%Y-%m-%d') as d, model,
    cast(floor(value*10) as bigint) it, cast(floor(value) as bigint) ot, k*10 cw, k*1000 cr,
    case when event_type in ('click','purchase') and top_level then k % 4 else 0 end n_tools
  from ev)""",
    "tools": """tools as (
  select project_id, session_id, event_id, 't'||(k % 4) tool_id,
    (['Bash','Edit','Read','Grep','Write'])[(k % 5)+1] tool_name
  from ev where event_type in ('click','purchase') and top_level)""",
    "facts": """facts as (
  select project_id, session_id, file_path, top_level, event_id seq,
    case when event_type in ('view','signup') then 'user' when event_type='error' then 'system' else 'assistant' end "type",
    case when k % 7 <> 0 then tstamp end tstamp,
    case when k % 3 <> 0 then '/home/'||project_id end cwd,
    case when k % 5 <> 0 then 'branch-'||(k % 5) end git_branch,
    case when k % 4 <> 0 then '1.0.'||(k % 4) end version,
    event_type='error' and k % 2 = 0 is_full, event_type='error' and k % 2 = 1 is_micro,
    case when event_type='error' and k % 2 = 1 then k*100 else 0 end saved
  from ev)""",
    "snaps": """snaps as (
  select project_id, session_id, file_path, project_id||'-'||strftime(ts,'%Y-%m-%d-%H') turn_key, event_id seq, top_level,
    case when k % 6 <> 0 then tstamp end tstamp, case when k % 4 <> 0 then model end model,
    event_type <> 'error' used,
    cast(floor(value*10) as bigint) it, cast(floor(value) as bigint) ot, k*10 cw, k*1000 cr, k*7 c5, k*3 c1,
    case when k % 2 = 0 then 'standard' else 'batch' end tier,
    event_type='view' thinking, event_type in ('click','purchase') visible, event_type='purchase' ends,
    event_type, k
  from ev)""",
    "prices": f"prices(price_key, provider, pi, po, pw, pr, ord) as (values {_price_values()})",
    "scored": """parts as (
  select *, string_split(replace(price_key,'.','-'),'-') p,
    case when contains(price_key,'opus') then 'opus' when contains(price_key,'sonnet') then 'sonnet' when contains(price_key,'haiku') then 'haiku' end fam
  from prices),
scored as (
  select *, coalesce(case when regexp_full_match(vmaj,'\\d+') and not regexp_full_match(vmaj,'\\d{8}') then cast(vmaj as bigint) end, 0) major,
    coalesce(case when regexp_full_match(vmin,'\\d+') and not regexp_full_match(vmin,'\\d{8}') then cast(vmin as bigint) end, 0) minor,
    coalesce(list_max([cast(x as bigint) for x in p if regexp_full_match(x,'\\d{8}')]), 0) rel
  from (select *, case when list_position(p,fam)=2 then p[3] when list_position(p,fam)>2 then p[2] end vmaj,
      case when list_position(p,fam)=2 then p[4] when list_position(p,fam)=4 then p[3] end vmin from parts))""",
    "pm": """ids as (
  select model, replace(case when contains(lower(trim(model)),'claude-') then regexp_extract(lower(trim(model)),'^.*(claude-.*)$',1) else lower(trim(model)) end,'.','-') id
  from (select distinct model from turns)),
pm as (
  select model, price_key, pi, po, pw, pr from (
    select i.model, s.*, row_number() over (partition by i.model order by
      case when s.price_key = i.id then 1 when starts_with(i.id, s.price_key||'-') or starts_with(s.price_key, i.id||'-') then 2 else 3 end,
      major desc, minor desc, rel desc, length(s.price_key) desc, s.price_key) rn
    from ids i join scored s on s.price_key = i.id or starts_with(i.id, s.price_key||'-') or starts_with(s.price_key, i.id||'-')
      or s.fam = (case when contains(i.id,'opus') then 'opus' when contains(i.id,'sonnet') then 'sonnet' when contains(i.id,'haiku') then 'haiku' end)
  ) where rn = 1)""",
}
PRICED = ["ev", "turns", "prices", "scored", "pm"]


def with_(names: list[str], body: str, *extra: str) -> str:
    return "with " + ",\n".join([CTE[n] for n in names] + list(extra)) + "\n" + body


def _amount(tokens: str, price: str) -> str:
    return f"cast({tokens} as decimal(18,0)) * {price}"


SHARES = {"api": ("1.00", "1.00"), "conservative": ("0.15", "0.05"), "subscription": ("0.08", "0.01")}


def micro(mode: str, it: str = "it", ot: str = "ot", cw: str = "cw", cr: str = "cr") -> str:
    w, r = SHARES[mode]
    return (
        f"coalesce(cast({_amount(it, 'pi')} + {_amount(ot, 'po')} + {_amount(cw, 'pw')} * {w}::decimal(3,2) "
        f"+ {_amount(cr, 'pr')} * {r}::decimal(3,2) as decimal(38,10)), cast(0 as decimal(38,10)))"
    )


def micros() -> str:
    return ", ".join(f"{micro(m)} micro_{m}" for m in SHARES)


def usd(expr: str, digits: int = 4) -> str:
    step = 10 ** (6 - digits)
    return f"cast((cast(floor({expr}) as bigint) + {step // 2}) // {step} as double) / cast({10**digits} as double)"


def sum_costs() -> str:
    return ", ".join(f"{usd(f'sum(micro_{m})')} cost_{m}" for m in SHARES)


def costs() -> str:
    return ", ".join(f"{usd(f'micro_{m}')} cost_{m}" for m in SHARES)


def sum_micros() -> str:
    return ", ".join(f"cast(sum(micro_{m}) as decimal(38,10)) micro_{m}" for m in SHARES)


SUM_TOKENS = (
    "cast(sum(it) as bigint) input_tokens, cast(sum(ot) as bigint) output_tokens, "
    "cast(sum(cw) as bigint) cache_write_tokens, cast(sum(cr) as bigint) cache_read_tokens"
)
USAGE = (
    "usage as (select u.*, " + micros() + " from (select model, sum(it)::bigint it, sum(ot)::bigint ot, sum(cw)::bigint cw, "
    "sum(cr)::bigint cr from turns group by model) u left join pm using (model))"
)
