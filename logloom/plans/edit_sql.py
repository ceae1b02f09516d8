"""SQL answers for file changes (DuckDB dialect): the fold over the edits of a file as a recursive query.

A step of the recursion takes in the next edit of every file at once. Its state holds the texts written so far with their
lines, and the passages that edits have made; lists of them are searched by lambdas. Edits of the log lines replace
two lines by three, so an edit moves what lies behind it by one line.
"""

from __future__ import annotations

# ``shown`` is the line at which a tool result before the edit last showed its old text.
_EDITS = """reads as (select sid, 't'||(k % 3) tid, arg_max(k, event_id) rk from lines where event_type = 'click' and k % 4 = 0 group by all),
results as (select l.sid, l.path, l.event_id seq, l.k % 12 a, l.k % 5 b, coalesce(r.rk + 1, 1) top
  from lines l left join reads r on r.sid = l.sid and r.tid = 't'||(l.k % 3) where l.event_type = 'purchase'),
shown as (select e.event_id seq, arg_max(r.top, r.seq) shown from edits e join results r on r.sid = e.sid and r.path = e.path and r.a = e.k % 12 and r.b = e.k % 5 and r.seq < e.event_id group by all),
asked as (select sid, e.path, event_id seq, row_number() over (partition by sid, e.path order by event_id) n, k % 12 a, k % 5 b,
    ['line '||(k % 12), 'keep '||(k % 5)] old, ['line '||(k % 12 + 4), 'keep '||(k % 5), 'added'] new, case when k % 8 = 1 then k + 1 end given, shown
  from edits e left join shown s on s.seq = event_id)"""
# Searched in this order: the line the edit names, the last text written that holds the old one, the last one shown.
_PLACED = """coalesce(e.given, list_filter(s.written, lambda w: w.line is not null and w.a + 4 = e.a and w.b = e.b)[-1].line, e.shown)"""
# What an edit finds in passage p: ``spot`` is where the old text stands in it, ``meets`` whether its lines touch it.
_FOUND = """list_transform(s.passages, lambda p, i: {
    'no': i, 'spot': list_filter(range(0, len(p.now) - 1), lambda j: p.now[j + 1] = q.old[1] and p.now[j + 2] = q.old[2])[1],
    'meets': coalesce(q.line between p.line - 2 and p.line + 2, false), 'inside': coalesce(q.line between p.line and p.line + len(p.now), false), 'depth': q.line - p.line})"""
FOLD = f"""{_EDITS},
fold as (
  select distinct sid, path, 0::bigint n, [{{'a': 0::bigint, 'b': 0::bigint, 'line': null::bigint}}] written,
    []::struct(line bigint, "before" varchar[], "now" varchar[], first_n bigint, last_n bigint)[] passages from asked
  union all
  select sid, path, n, written, case
      when touched is null or (touched.spot is null and not touched.inside)
        then list_append(passages, {{'line': line, 'before': old, 'now': old[:0] || new, 'first_n': n, 'last_n': n}})
      else list_transform(passages, lambda p, i: case when i <> touched.no then p else {{'line': p.line, 'before': p.before,
        'now': p.now[:coalesce(touched.spot, touched.depth)] || new || p.now[coalesce(touched.spot, touched.depth) + 3:], 'first_n': p.first_n, 'last_n': n}} end) end
  from (select *, list_filter(found, lambda f: f.spot is not null or f.meets)[1] touched
    from (select q.*, {_FOUND.replace('s.passages', 'q.passages')} found
      from (select s.sid, s.path, e.n, {_PLACED} line, list_append(s.written, {{'a': e.a, 'b': e.b, 'line': {_PLACED}}}) written, s.passages, e.old, e.new
        from fold s join asked e on e.sid = s.sid and e.path = s.path and e.n = s.n + 1) q)))"""
# Lines before all earlier shifts: undone from the last one before the line on. Net hunks start behind all shifts again.
_SORTED = "list_sort(list_filter(list_transform({}, lambda w: w.line), lambda l: l is not null))"
HUNKS = f"""placed as (select e.pid, e.sid, e.path, e.event_id, e.tstamp, 't'||(e.k % 3) tid, a.n, a.old, a.new, case when e.k % 8 = 1 then 'line '||(e.k + 1) end as location, f.written[-1].line line,
    case when f.written[-1].line is not null
      then greatest(1, list_reduce([f.written[-1].line] || list_reverse({_SORTED.format('f.written[:-2]')}), lambda x, l: x - (x > l)::bigint)) end original
  from fold f join asked a on a.sid = f.sid and a.path = f.path and a.n = f.n join edits e on e.event_id = a.seq),
ended as (select * from fold qualify n = max(n) over (partition by sid, path)),
opened as (select sid, path, n, unnest(range(len(passages))) hunk_no, unnest(passages) p, {_SORTED.format('written')} shifts from ended),
spans as (select o.sid, o.path, hunk_no, p.before old, p.now new, p.last_n last_n, b.original first,
    case when b.original is null then p.line else greatest(1, list_reduce([b.original] || shifts, lambda x, l: x + (x > l)::bigint)) end here
  from opened o join placed b on b.sid = o.sid and b.path = o.path and b.n = p.first_n where p.before <> p.now),
spots as (select *, len(new) size, list_position(new, old[1]) x, list_position(new, old[2]) y,
    list_filter(range(1, len(new) + 1), lambda j: new[j] = old[2] and j > list_position(new, old[1]))[1] y_behind from spans),
-- where the two old lines stand among the new ones: equal ends first, then the earliest common subsequence
matched as (select *,
    case when new[1] = old[1] then 1 when new[-1] = old[2] then case when size > 1 and new[-2] = old[1] then size - 1 when x < size then x end
      when y_behind is not null or y is null or x < y then x end x_at,
    case when new[1] = old[1] then case when size > 1 and new[2] = old[2] then 2 when size > 1 and new[-1] = old[2] then size else y_behind end
      when new[-1] = old[2] then size when y_behind is not null then y_behind when x is null or y < x then y end y_at from spots),
net as (select *, coalesce(x_at, 0) x_end, coalesce(y_at, 0) y_end, (x_at is not null)::bigint + (y_at is not null)::bigint same from matched),
told as (select *, list_concat(
    case when x_at is null then ['-'||old[1]] else list_transform(new[:x_at - 1], lambda r: '+'||r) || [' '||old[1]] end,
    case when y_at is null then ['-'||old[2]] else list_transform(new[x_end + 1:y_at - 1], lambda r: '+'||r) || [' '||old[2]] end,
    list_transform(new[greatest(x_end, y_end) + 1:], lambda r: '+'||r)) signed from net),
hunks as (
  select pid project_id, sid session_id, path, 'edit' hunk_kind, null::bigint hunk_no, event_id seq, 0::bigint pos, tstamp as "timestamp", 'Edit' tool_name, tid tool_id,
    coalesce(location, 'line '||line) as location, line old_start, line new_start, original original_line,
    ['-'||old[1], '+'||new[1], ' '||old[2], '+added'] signed, 2::bigint added, 1::bigint removed, 2::bigint old_count, 3::bigint new_count from placed
  union all
  select p.pid, p.sid, p.path, 'net', hunk_no, event_id, 0, tstamp, 'Net diff', tid, 'line '||first, first, here, first, signed, size - same, 2 - same, 2, size
  from told t join placed p on p.sid = t.sid and p.path = t.path and p.n = t.last_n)"""
CHANGES = """changes as (select project_id, session_id, path, coalesce(sum(added) filter (where hunk_kind = 'net'), 0)::bigint added,
    coalesce(sum(removed) filter (where hunk_kind = 'net'), 0)::bigint removed, count(*) filter (where hunk_kind = 'edit') edits from hunks group by all)"""
PATCHES = """wanted as (select * from hunks qualify hunk_kind = case when bool_or(hunk_kind = 'net') over (partition by project_id, session_id, path) then 'net' else 'edit' end)"""
_RANGE = "coalesce({0}_start, 1)||case when {0}_count = 1 then '' else ','||{0}_count end"

ANSWERS = {
    "session_hunks": """select * exclude (signed), array_to_string(signed, '|') as "rows" from hunks""",
    "file_change_list": """select *, case when added > 0 and removed = 0 then 'added' when removed > 0 and added = 0 then 'deleted' else 'modified' end as "status" from changes""",
    "session_patches": f"""select session_id, path, coalesce(hunk_no, seq) part, 0::bigint subpart,
        '@@ -'||{_RANGE.format('old')}||' +'||{_RANGE.format('new')}||' @@ '||tool_name||chr(10)||array_to_string(signed, chr(10)) patch from wanted
      union all select distinct session_id, path, -1, -1, 'diff --git a/'||path||' b/'||path||chr(10)||'--- a/'||path||chr(10)||'+++ b/'||path from wanted""",
}


def edit_answers(with_lines: str) -> dict[str, str]:
    """SQL of the file change queries; ``with_lines`` is a WITH clause that ends with ``lines`` and ``edits``."""
    steps = ",\n".join([with_lines.replace("with ", "with recursive ", 1), FOLD, HUNKS, CHANGES, PATCHES])
    return {name: f"{steps}\n{sql}" for name, sql in ANSWERS.items()}
