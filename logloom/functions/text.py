"""Scalar text, path, number and command functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the log writers trim it: ASCII plus the Unicode space separators.
SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LINE_BREAK = r"\r\n?|\n"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


def non_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"), F.lit(False))


def non_empty(text: Column) -> Column:
    """NULL for the empty string, the text otherwise."""
    return F.when(text != "", text)


def group_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, NULL (not '') when nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def grouped(number: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(number, 0)


# --- commands -------------------------------------------------------------------------------


def extract_command(text: Column) -> Column:
    """Slash-command markup of a user text as struct(kind, content, is_meta); NULL without markup."""
    caveat = r"(?s)<local-command-caveat>(.*?)</local-command-caveat>"
    name = r"(?s)<command-name>(.*?)</command-name>"
    args = r"(?s)<command-args>(.*?)</command-args>"
    stdout = r"(?s)<local-command-stdout>(.*?)</local-command-stdout>"

    has_caveat, has_name, has_stdout = (F.coalesce(text.rlike(p), F.lit(False)) for p in (caveat, name, stdout))
    arg_text = trim_space(F.regexp_extract(text, args, 1))
    call = trim_space(F.regexp_extract(text, name, 1))
    content = (
        F.when(has_caveat, trim_space(F.regexp_extract(text, caveat, 1)))
        .when(has_name, F.when(arg_text != "", F.concat_ws(" ", call, arg_text)).otherwise(call))
        .when(
            has_stdout,
            trim_space(F.regexp_replace(F.regexp_extract(text, stdout, 1), r"\x1b\[[0-9;]*m", "")),
        )
    )
    kind = F.when(has_caveat, "caveat").when(has_name, "name").when(has_stdout, "stdout")
    return F.when(
        has_caveat | has_name | has_stdout,
        F.struct(kind.alias("kind"), content.alias("content"), has_caveat.alias("is_meta")),
    )


# --- paths ----------------------------------------------------------------------------------


def project_path(project_id: Column) -> Column:
    """Directory path encoded in a project id: every dash stands for a slash."""
    return F.translate(project_id, "-", "/")


def project_name(project_id: Column) -> Column:
    tail = F.element_at(F.split(project_path(project_id), "/", -1), -1)
    return F.coalesce(non_empty(tail), project_id)


def normalise_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")


def unescape_newlines(text: Column) -> Column:
    """Turn escaped line breaks into real ones, unless the text already has a real one."""
    escaped = F.regexp_replace(text, r"\\r\\n|\\n", "\n")
    return F.when(text.rlike(r"[\r\n]"), text).otherwise(escaped)


def relative_path(path: Column, root: Column | None = None) -> Column:
    """Line by line: trimmed, slashes unified, and the project root cut off whatever its case."""
    base = None if root is None else F.regexp_replace(normalise_path(root), r"/\z", "")

    def one(line: Column) -> Column:
        clean = normalise_path(trim_space(line))
        if base is None:
            return clean
        inside = F.startswith(F.lower(clean), F.lower(F.concat(base, F.lit("/"))))
        return (
            F.when(clean == "", clean)
            .when(base.isNull(), clean)
            .when(F.lower(clean) == F.lower(base), F.lit("."))
            .when(inside, F.substring(clean, F.length(base) + 2, F.length(clean)))
            .otherwise(clean)
        )

    return F.array_join(F.transform(F.split(unescape_newlines(path), LINE_BREAK), one), "\n")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(normalise_path(path), "/"), lambda p: p != "")


def split_path(path: Column) -> Column:
    """struct(prefix, basename); the prefix of a path over 42 characters is shortened."""
    clean = normalise_path(path)
    parts = path_parts(path)
    n = F.size(parts)
    full = F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "/"), F.lit("/"))
    prefix = (
        F.when(n <= 1, F.lit(""))
        .when(F.length(clean) <= 42, full)
        .otherwise(F.concat(F.get(parts, F.lit(0)), F.lit(".../")))
    )
    base = F.when(n <= 1, clean).otherwise(F.get(parts, n - 1))
    return F.struct(prefix.alias("prefix"), base.alias("basename"))


def edit_path(path: Column) -> Column:
    """Slashes unified and a leading ./ removed."""
    return F.regexp_replace(normalise_path(path), r"\A\./", "")


def diff_key(path: Column) -> Column:
    return F.lower(edit_path(path))


def basename(path: Column) -> Column:
    clean = F.translate(path, "\\", "/")
    return F.coalesce(non_empty(F.element_at(F.split(clean, "/", -1), -1)), clean)


def is_bare_name(path: Column) -> Column:
    return ~path.rlike(r"[\\/]")


def is_likely_path(value: Column) -> Column:
    shape = value.rlike(r"[\\/]") | value.rlike(r"\.[A-Za-z0-9]{1,12}\z")
    return value.isNotNull() & ~value.isin("", "[]", '""') & shape


# --- numbers in text ------------------------------------------------------------------------


def parse_line_number(value: Column) -> Column:
    """``1,234``, ``line 42`` or leading non-digits followed by a number."""
    bare = F.regexp_replace(trim_space(value), ",", "")
    text = F.coalesce(
        group_or_null(bare, r"\A(\d+)\z"),
        group_or_null(value, r"(?i)\bline\s+(\d+)\b"),
        group_or_null(value, r"\A\D*(\d+)"),
    )
    return text.try_cast("bigint")


def parse_line_count(value: Column) -> Column:
    """Digits and commas only, NULL for anything else."""
    bare = trim_space(F.regexp_replace(value, ",", ""))
    return group_or_null(bare, r"\A(\d+)\z").try_cast("bigint")


def parse_exit_code(value: Column) -> Column:
    text = trim_space(value)
    found = F.coalesce(
        group_or_null(text, r"\A(-?\d+)\z"),
        group_or_null(text, r"(?i)\bexit\s+code\b\s*:?\s*(-?\d+)"),
        group_or_null(text, r"(?i)\bexit\b\s*:?\s*(-?\d+)"),
    )
    return found.try_cast("bigint")


def tone(code: Column) -> Column:
    return F.when(code.isNull(), "unknown").when(code == 0, "success").otherwise("error")


# --- file language --------------------------------------------------------------------------

# File extension -> language.
EXTENSION_LANGUAGE = {
    "c": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "css": "css", "cts": "typescript",
    "cxx": "cpp", "go": "go", "h": "c", "hh": "cpp", "hpp": "cpp", "htm": "html", "html": "html",
    "hxx": "cpp", "java": "java", "js": "javascript", "json": "json", "jsonl": "json",
    "jsx": "javascript", "md": "markdown", "mdx": "markdown", "mjs": "javascript",
    "mts": "typescript", "ps1": "powershell", "psm1": "powershell", "py": "python",
    "pyi": "python", "rs": "rust", "sh": "bash", "sql": "sql", "ts": "typescript",
    "tsx": "typescript", "txt": "markdown", "xml": "xml", "yaml": "yaml", "yml": "yaml",
    "zsh": "bash",
}

# Language -> label.
LANGUAGE_LABEL = {
    "bash": "Shell", "c": "C", "cpp": "C++", "csharp": "C#", "css": "CSS", "go": "Go",
    "html": "HTML", "java": "Java", "javascript": "JavaScript", "json": "JSON",
    "markdown": "Markdown", "powershell": "PowerShell", "python": "Python", "rust": "Rust",
    "sql": "SQL", "typescript": "TypeScript", "xml": "XML", "yaml": "YAML",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, NULL for unknown keys."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def file_extension(path: Column) -> Column:
    name = F.regexp_replace(
        F.get(F.split(F.lower(trim_space(path)), "[?#]"), F.lit(0)), r"(?s)\A.*[\\/]", ""
    )
    return F.when(name.rlike(r"\.d\.[mc]?ts\z"), F.lit("ts")).otherwise(
        group_or_null(name, r"(?s)\A.+\.([^.]+)\z")
    )


def code_language(path: Column) -> Column:
    docker = F.endswith(F.lower(trim_space(path)), F.lit("dockerfile"))
    return F.when(docker, F.lit("bash")).otherwise(lookup(EXTENSION_LANGUAGE, file_extension(path)))


def language_label(language: Column) -> Column:
    return lookup(LANGUAGE_LABEL, language)
