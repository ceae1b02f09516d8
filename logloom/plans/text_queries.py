"""Queries over texts, paths and numbers built from whole documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import details as D
from logloom.functions import text as X
from logloom.functions.models import model_display, normalise_model
from logloom.operators.context import count_tokens
from logloom.sources import tables as t


def extract_command(spark: SparkSession, d: str) -> DataFrame:
    """Command markup around whole document texts."""
    docs = t.load(spark, d, "documents")
    text = F.expr("""case doc_id % 5
        when 0 then concat('<command-name> /do-', lang, ' </command-name><command-args>', text, '</command-args>')
        when 1 then concat('<command-name>/', source, '</command-name><command-args></command-args>')
        when 2 then concat('x<local-command-stdout>', char(27), '[31m', text, char(27), '[0m </local-command-stdout>')
        when 3 then concat('<local-command-caveat>', text, '</local-command-caveat><command-name>n</command-name>')
        else text end""")
    rows = docs.select("doc_id", X.extract_command(text).alias("c"))
    return rows.select("doc_id", "c.kind", "c.content", "c.is_meta")


def detail_format(spark: SparkSession, d: str) -> DataFrame:
    docs = t.load(spark, d, "documents")
    key = F.expr("element_at(array('command', 'content', 'a.signature', 'file.stdout', 'query'), cast(doc_id % 5 + 1 as int))")
    docs = docs.withColumn("clean", X.trim_space(F.col("text")))
    clean = F.col("clean")
    return docs.select(
        "doc_id", D.format_text_detail(key, clean).alias("tool_value"), D.format_text_detail(key, clean, True).alias("record_value"),
        D.summarise_large(F.col("text")).alias("size_note"), D.humanise(key).alias("label"),
    )


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return t.load(spark, d, "documents").select("doc_id", count_tokens(F.col("text")).alias("tokens"))


def model_names(spark: SparkSession, d: str) -> DataFrame:
    part = t.load(spark, d, "part")
    raw = F.expr("""concat(element_at(array('eu.anthropic.Claude-', ' claude-', 'GPT-', 'x/claude-y/claude-', ''), cast(p_partkey % 5 + 1 as int)),
        element_at(array('Opus-4.', 'sonnet-', 'haiku.', 'synthetic-', 'other '), cast(p_size % 5 + 1 as int)), p_size)""")
    return part.select("p_partkey", model_display(raw).alias("display_name"), normalise_model(raw).alias("model_id"))


def _part_id():
    return F.expr("concat('-', replace(p_name, ' ', '-'), case when p_size % 7 = 0 then '-' else '' end, p_brand)")


def project_naming(spark: SparkSession, d: str) -> DataFrame:
    ident = _part_id()
    return t.load(spark, d, "part").select("p_partkey", X.project_path(ident).alias("path"), X.project_name(ident).alias("name"))


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    pages = t.load(spark, d, "pages")
    path = F.expr("concat(case page_id % 3 when 0 then '.\\\\_' when 1 then './' else 'C:\\\\Repo\\\\App//' end, substring_index(url, '//', -1))")
    lines = F.concat(F.lit(" c:/repo/app\\n"), path, F.lit("\\n"))
    return pages.select(
        "page_id", X.normalise_path(path).alias("normalised"), X.relative_path(lines, F.lit("c:\\repo\\App/")).alias("relative"),
        X.split_path(path)["prefix"].alias("prefix"), X.split_path(path)["basename"].alias("basename"),
        X.diff_key(path).alias("diff_key"), X.is_likely_path(path).alias("likely"), X.is_bare_name(path).alias("bare"),
    ).withColumn("relative", F.replace("relative", F.lit("\n"), F.lit("|")))


def number_parsing(spark: SparkSession, d: str) -> DataFrame:
    part = t.load(spark, d, "part")
    raw = F.expr("""case p_partkey % 6 when 0 then concat(' ', p_size, ',', p_partkey, ' ') when 1 then concat('see LINE  ', p_partkey)
        when 2 then concat('L', p_size, ': ', p_partkey) when 3 then p_name when 4 then concat(p_size, ' lines') else '' end""")
    return part.select("p_partkey", X.parse_line_number(raw).alias("line"), X.parse_line_count(raw).alias("line_count"))


def detail_search(spark: SparkSession, d: str) -> DataFrame:
    """Detail lookup by key or tail on per-part details, and newline un-escaping."""
    details = F.expr("""array(named_struct('key', 'content.file.filePath', 'value', p_name), named_struct('key', p_brand, 'value', p_type),
        named_struct('key', if(p_size % 2 = 0, 'path', 'a.path'), 'value', concat(p_size, '')))""")
    raw = F.expr("concat(p_name, if(p_size % 3 = 0, '\\n', ''), '\\\\n', p_type)")
    rows = t.load(spark, d, "part").withColumn("details", details)
    return rows.select(
        "p_partkey", D.detail_lookup(F.col("details"), ["path", "filePath"]).alias("first_value"),
        D.detail_preferred(F.col("details"), ["path", "filePath"]).alias("preferred_value"),
        D.detail_lookup(F.col("details"), ["missing"]).alias("missing_value"),
        F.replace(X.unescape_newlines(raw), F.lit("\n"), F.lit("|")).alias("unescaped"),
    )


def tool_failure_rate(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of tool runs per tool: exit code from text, tone and share of errors."""
    ev = t.events_base(spark, d)
    raw = F.expr("""case k % 5 when 0 then concat('', k % 3) when 1 then concat('Process exit code: ', k % 2) when 2 then concat('Exit ', k % 4)
        when 3 then concat('exit code -', k) else 'still running' end""")
    code = X.parse_exit_code(raw)
    rows = ev.select("event_type", code.alias("code")).withColumn("tone", X.tone(F.col("code")))
    out = rows.groupBy("event_type").agg(
        F.count("*").alias("runs"), F.count_if(F.col("tone") == "error").alias("errors"), F.count_if(F.col("tone") == "success").alias("successes"),
        F.count_if(F.col("tone") == "unknown").alias("unknown"), F.min("code").alias("lowest_code"),
    )
    return out.withColumn("error_rate", F.col("errors").cast("double") / F.col("runs").cast("double"))


def language_mix(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the files touched, from paths made of page addresses."""
    path = F.expr("""concat(url, '/', element_at(array('a.TS', 'b.d.mts', 'Dockerfile', '.gitignore', 'c.py?x=1', 'd.unknown', 'e.tar.md'),
        cast(page_id % 7 + 1 as int)))""")
    pages = t.load(spark, d, "pages").select(F.regexp_replace(path, "[?#][^/]*/", "/").alias("path"))
    language = X.code_language(F.col("path"))
    return pages.groupBy(language.alias("language"), X.language_label(language).alias("label")).agg(F.count("*").alias("files"))


QUERIES = {
    f.__name__: f
    for f in (
        extract_command, detail_format, token_estimate, model_names, project_naming, path_functions, number_parsing,
        detail_search, tool_failure_rate, language_mix,
    )
}

WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def inline(x: str, n: int) -> str:
    one = trim(f"regexp_replace({x}, '{WS}+', ' ', 'g')")
    return f"case when length({one}) <= {n} then {one} else regexp_replace(left({one}, {n - 3}), '{WS}+\\z', '')||'...' end"


def size_note(x: str) -> str:
    lines = f"len(regexp_split_to_array({x}, '\\r\\n?|\\n'))"
    return f"case when {lines} > 1 then format('{{:,}}', {lines})||' lines' else format('{{:,}}', length({x}))||' chars' end"


ORACLE = {
    "extract_command": f"""select doc_id, kind, content, is_meta from (
      select doc_id, case doc_id % 5 when 0 then 'name' when 1 then 'name' when 2 then 'stdout' when 3 then 'caveat' end kind,
        case doc_id % 5 when 0 then '/do-'||lang||case when {trim('text')} = '' then '' else ' '||{trim('text')} end when 1 then '/'||source
          when 2 then {trim('text')} when 3 then {trim('text')} end content,
        case doc_id % 5 when 4 then null else doc_id % 5 = 3 end is_meta from documents)""",
    "detail_format": f"""select doc_id, case when clean = '' then '""' when key = 'content' then {size_note('clean')} else {inline('clean', 160)} end tool_value,
      case when clean = '' then '""' when key = 'a.signature' then {inline('clean', 72)}||' ('||format('{{:,}}', length(clean))||' chars)'
        when key in ('content', 'file.stdout') then {size_note('clean')} else {inline('clean', 220)} end record_value,
      {size_note('text')} size_note,
      (['Command','Content','A signature','File stdout','Query'])[(doc_id % 5) + 1] as label
      from (select doc_id, text, {trim('text')} clean, (['command','content','a.signature','file.stdout','query'])[(doc_id % 5) + 1] as key from documents)""",
    "token_estimate": f"select doc_id, len(regexp_extract_all({trim('text')}, '\\w{{1,6}}|[^\\w\\s]'))::bigint tokens from documents",
    "model_names": """select p_partkey, case when contains(lower(raw),'synthetic') then 'Synthetic' when contains(lower(raw),'opus') then 'Opus'
        when contains(lower(raw),'sonnet') then 'Sonnet' when contains(lower(raw),'haiku') then 'Haiku' else raw end display_name,
      replace(list_extract(list_transform([lower(trim(raw))], lambda x: case when contains(x,'claude-') then 'claude-'||list_last(string_split(x,'claude-')) else x end), 1),'.','-') model_id
      from (select p_partkey, (['eu.anthropic.Claude-',' claude-','GPT-','x/claude-y/claude-',''])[(p_partkey % 5)+1]||(['Opus-4.','sonnet-','haiku.','synthetic-','other '])[(p_size % 5)+1]||p_size raw from part)""",
    "project_naming": """select p_partkey, replace(i,'-','/') path, case when list_last(string_split(replace(i,'-','/'),'/')) = '' then i else list_last(string_split(replace(i,'-','/'),'/')) end as name
      from (select p_partkey, '-'||replace(p_name,' ','-')||case when p_size % 7 = 0 then '-' else '' end||p_brand i from part)""",
    "path_functions": r"""select page_id, n normalised,
      '.|'||case when starts_with(lower(n),'c:/repo/app/') then substr(n, 13) else n end||'|' as relative,
      case when len(p) <= 1 then '' when length(n) <= 42 then array_to_string(p[1:len(p)-1],'/')||'/' else p[1]||'.../' end as prefix,
      case when len(p) <= 1 then n else p[len(p)] end basename, lower(case when starts_with(n,'./') then substr(n,3) else n end) diff_key,
      true likely, false bare
      from (select page_id, n, list_filter(string_split(n,'/'), lambda x: x <> '') p from (
        select page_id, regexp_replace(replace(case page_id % 3 when 0 then '.\_' when 1 then './' else 'C:\Repo\App//' end||list_last(string_split(url,'//')),'\','/'),'/+','/','g') n from pages))""",
    "number_parsing": """select p_partkey, case p_partkey % 6 when 0 then cast(cast(p_size as varchar)||cast(p_partkey as varchar) as bigint) when 1 then p_partkey when 2 then p_size when 3 then null when 4 then p_size end::bigint line,
      case p_partkey % 6 when 0 then cast(cast(p_size as varchar)||cast(p_partkey as varchar) as bigint) end line_count from part""",
    "detail_search": """select p_partkey, p_name first_value, cast(p_size as varchar) preferred_value, cast(null as varchar) missing_value,
      case when p_size % 3 = 0 then p_name||'|'||chr(92)||'n'||p_type else p_name||'|'||p_type end unescaped from part""",
    "tool_failure_rate": """select event_type, count(*) runs, count(*) filter (where code <> 0) errors, count(*) filter (where code = 0) successes, count(*) filter (where code is null) as unknown,
      min(code) lowest_code, cast(count(*) filter (where code <> 0) as double) / cast(count(*) as double) error_rate
      from (select event_type, case k % 5 when 0 then k % 3 when 1 then k % 2 when 2 then k % 4 when 3 then -k end code
        from (select event_type, cast(json_extract_string(props,'$.k') as bigint) k from events)) group by event_type""",
    "language_mix": """select (['typescript','typescript','bash',null,'python',null,'markdown'])[i] as language, (['TypeScript','TypeScript','Shell',null,'Python',null,'Markdown'])[i] as label, sum(n)::bigint files
      from (select (page_id % 7)+1 i, count(*) n from pages group by 1) group by all""",
}
