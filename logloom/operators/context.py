"""Context-window composition: token estimates, prompt buckets and running context."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import variants as V
from logloom.functions.text import non_blank, non_empty, trim_space
from logloom.operators.records import DIMS, is_user, usage_columns
from logloom.operators.scans import Stage, chunk_scan
from logloom.session import cut_lineage

# Ship the counter with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = ("system", "conversation", "files", "thinking", "tool", "other")
# A counter maps an array of texts to an array of token counts (an Arrow UDF fits, too).
Counter = Callable[[Column], Column]
# A counter in Python, for :func:`count_texts`.
TextCounter = Callable[[list[str]], list[int]]

USAGE_SEGMENTS = {
    "input": "input_tokens", "cache-read": "cache_read_tokens", "output": "output_tokens", "cache-write": "cache_write_tokens",
}
# A word is cut into pieces of up to six characters; every other visible character counts alone.
PIECES = r"\w{1,6}|[^\w\s]"
_PIECES = re.compile(PIECES, re.ASCII)


def count_tokens(text: Column) -> Column:
    """Estimated tokens of one text."""
    return F.coalesce(F.regexp_count(trim_space(text), F.lit(PIECES)), F.lit(0)).cast("bigint")


def estimate(texts: Column) -> Column:
    """Default counter: :func:`count_tokens` of every text."""
    return F.transform(texts, count_tokens)


def serialised(value: Column) -> Column:
    """Text whose tokens are counted for any JSON value; NULL for null."""
    return F.when(V.is_null(value), F.lit(None).cast("string")).when(
        V.is_string(value) | V.is_number(value) | V.is_boolean(value), V.as_string(value)
    ).otherwise(F.to_json(value))


def _part(bucket: str, text: Column) -> Column:
    return F.struct(F.lit(bucket).alias("bucket"), F.coalesce(text, F.lit("")).alias("text"))


def _present(*values: Column) -> Column:
    """First value that is neither absent nor null."""
    return F.coalesce(*[F.when(~V.is_null(v), v) for v in values])


def _type_only(block: Column) -> Column:
    kind = V.get(block, "type")
    return F.when(V.is_null(kind), F.lit("{}")).otherwise(F.concat(F.lit('{"type":'), F.to_json(kind), F.lit("}")))


def _image(block: Column) -> Column:
    """Descriptor of an image block; its payload never counts."""
    source = V.get(block, "source")
    words = lambda v, n: non_empty(trim_space(V.string_at(v, n)))
    size = lambda n: V.number_at(source, n)
    inner = F.struct(
        words(source, "type").alias("type"), words(source, "media_type").alias("media_type"),
        *[size(n).alias(n) for n in ("width", "height", "width_px", "height_px")],
    )
    inner_json = F.to_json(inner)
    outer = F.to_json(
        F.struct(
            F.lit("image").alias("type"), words(block, "alt_text").alias("alt_text"),
            words(block, "file_id").alias("file_id"), words(block, "filename").alias("filename"),
        )
    )
    with_source = F.concat(F.regexp_replace(outer, r"\}\z", ""), F.lit(',"source":'), inner_json, F.lit("}"))
    return F.when(V.is_object(source) & (inner_json != "{}"), with_source).otherwise(outer)


def _typed(blocks: Column) -> Column:
    """Each block with its type, looked up once for all that ask for it."""
    return F.transform(
        blocks, lambda b: F.struct(b.alias("block"), V.is_object(b).alias("is_object"), V.string_at(b, "type").alias("kind"))
    )


def _user_part(typed: Column) -> Column:
    block, kind = typed["block"], typed["kind"]
    return (
        F.when(~typed["is_object"], _part("tool", serialised(block)))
        .when(kind == "text", _part("conversation", V.let(_present(V.get(block, "text"), V.get(block, "content"), block), serialised)))
        .when(kind == "tool_result", _part("tool", V.let(_present(V.get(block, "content"), block), serialised)))
        .when(kind == "image", _part("other", _image(block)))
        .otherwise(_part("other", _type_only(block)))
    )


def _assistant_part(typed: Column) -> Column:
    block, kind = typed["block"], typed["kind"]
    thought = F.coalesce(V.string_at(block, "thinking"), V.string_at(block, "text"))
    pair = lambda n: F.when(V.get(block, n).isNotNull(), F.concat(F.lit(f'"{n}":'), F.to_json(V.get(block, n))))
    call = F.concat(F.lit("{"), F.concat_ws(",", pair("name"), pair("input")), F.lit("}"))
    return (
        F.when(~typed["is_object"], _part("other", serialised(block)))
        .when(kind == "text", _part("conversation", V.let(V.get(block, "text"), serialised)))
        .when(kind.isin("thinking", "redacted_thinking"), _part("thinking", thought))
        .when(kind == "tool_use", _part("tool", call))
        .otherwise(_part("other", _type_only(block)))
    )


def _is_hidden(typed: Column) -> Column:
    """Thinking without text but with a signature."""
    block = typed["block"]
    thought = trim_space(F.coalesce(V.string_at(block, "thinking"), V.string_at(block, "text"), F.lit("")))
    return F.coalesce(
        typed["kind"].isin("thinking", "redacted_thinking") & (thought == "") & non_blank(V.string_at(block, "signature")),
        F.lit(False),
    )


def prompt_contributions(records: DataFrame, counter: Counter = estimate) -> DataFrame:
    """Tokens each top-level record adds to the context, in six buckets, and its hidden thinking blocks.

    ``counter`` works on columns; :func:`counted_contributions` takes a Python one.
    """
    rows = _with_parts(records).withColumn("_counts", counter(F.transform("parts", lambda p: p["text"])))
    paired = F.arrays_zip(F.transform("parts", lambda p: p["bucket"]).alias("bucket"), F.col("_counts").alias("n"))
    rows = rows.withColumn("_paired", paired)
    total = lambda b: F.aggregate(
        "_paired", F.lit(0).cast("bigint"), lambda acc, p: acc + F.when(p["bucket"] == b, p["n"]).otherwise(0)
    )
    return rows.withColumns({b: total(b) for b in BUCKETS}).drop("parts", "_counts", "_paired")


def normalised_estimate(texts: list[str]) -> list[int]:
    """:func:`count_tokens` of texts in their compatibility form, where wide letters, ligatures and the like are plain ones."""
    return [len(_PIECES.findall(unicodedata.normalize("NFKC", t.strip()))) for t in texts]


def count_texts(texts: DataFrame, count: TextCounter) -> DataFrame:
    """(digest, n) of the distinct texts in column ``text``, each counted once, in Arrow batches.

    ``count`` maps a list of texts to a list of counts, for instance a tokenizer's. Equal texts are found by their SHA-256.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64())], names=["digest", "n"])

    once = texts.filter("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"))
    return once.mapInArrow(run, "digest string, n bigint")


def counted_contributions(records: DataFrame, count: TextCounter = normalised_estimate) -> DataFrame:
    """:func:`prompt_contributions` with a Python counter.

    A text that stands often, such as a file read again and again, is counted once, and its count joined back by digest. A
    digest that many records share is one row on the side of the counts, so the join can be split.
    """
    rows = cut_lineage(_with_parts(records))
    place = ["file_path", "seq"]
    parts = rows.select(*place, F.explode("parts").alias("p")).select(*place, "p.bucket", "p.text")
    counts = cut_lineage(count_texts(parts, count))
    met = parts.select(*place, "bucket", F.sha2("text", 256).alias("digest")).join(counts, "digest")
    sums = met.groupBy(*place).agg(*[F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).alias(b) for b in BUCKETS])
    out = rows.drop("parts").join(sums, place, "left")
    return out.withColumns({b: F.coalesce(F.col(b), F.lit(0).cast("bigint")) for b in BUCKETS})


def _with_parts(records: DataFrame) -> DataFrame:
    """Top-level records with their ``parts`` (bucket and text), hidden thinking blocks and usage."""
    message, result = F.col("message"), F.col("tool_use_result")
    is_assistant = F.col("type") == "assistant"
    # Columns of their own, as every use inside one expression would cut the content out of the message again.
    rows = records.filter("top_level").withColumns({
        "_is_user": is_user(),
        "_blocks": V.get(message, "content", "array<variant>"),
    })
    scalar = F.col("_blocks").isNull() & V.get(message, "content", "struct<>").isNull()
    rows = rows.withColumns({
        "_is_text": F.coalesce(F.when(scalar, V.kind_at(message, "content")) == "STRING", F.lit(False)),
        "_typed": F.when(is_assistant | (F.col("_is_user") & result.isNull()), _typed(F.col("_blocks"))),
    })
    has_blocks, typed = F.col("_blocks").isNotNull(), F.col("_typed")
    text = V.get(message, "content", "string")
    attachment = F.col("attachment")
    kind = F.coalesce(V.string_at(attachment, "type"), F.lit("attachment"))
    file_text = V.string_at(attachment, "content.file.content")
    joined = F.concat_ws("\n\n", V.string_at(attachment, "filename"), V.string_at(attachment, "displayPath"), file_text)
    attached = (
        F.when(kind == "file", _part("files", F.when(file_text.isNotNull(), joined).otherwise(serialised(attachment))))
        .when(kind == "hook_success", _part("other", serialised(attachment))).otherwise(_part("system", serialised(attachment)))
    )
    command = text.rlike("<command-name>|<local-command-stdout>|<local-command-caveat>")
    said = F.when(command | F.coalesce("is_meta", F.lit(False)), _part("system", text)).otherwise(_part("conversation", text))
    user_parts = (
        F.when(F.col("_is_text"), F.array(said))
        .when(has_blocks & result.isNotNull(), F.array(_part("tool", serialised(result))))
        .when(has_blocks, F.transform(typed, _user_part))
    )
    assistant_parts = F.when(F.col("_is_text"), F.array(_part("conversation", text))).when(has_blocks, F.transform(typed, _assistant_part))
    parts = (
        F.when(F.col("_is_user"), user_parts).when(is_assistant, assistant_parts)
        .when((F.col("type") == "attachment") & attachment.isNotNull(), F.array(attached))
    )
    none = F.array().cast("array<struct<bucket:string,text:string>>")
    hidden = F.when(is_assistant, F.size(F.filter(typed, _is_hidden)))
    return rows.select(
        *DIMS, "type", "timestamp", F.coalesce(parts, none).alias("parts"),
        F.greatest(F.coalesce(hidden, F.lit(0)), F.lit(0)).cast("bigint").alias("hidden_thinking"), *usage_columns()[:5],
    )


def running_context(
    df: DataFrame, keys: list[str], order: str, chunk: Column, assistant: Column, measures: list[str], prefix: str = "ctx_"
) -> DataFrame:
    """Sums of ``measures`` over all earlier rows, where a run of assistant rows does not see itself.

    One chunked pass: a row takes the running sum at the start of its run. When the run began in an
    earlier chunk, that chunk's value is carried over.
    """
    rows = df.withColumns({"_a": assistant, **{f"_v_{m}": F.coalesce(F.col(m), F.lit(0)) for m in measures}})
    upto = lambda w: w.rowsBetween(-(1 << 63), 0)
    before = lambda w: w.rowsBetween(-(1 << 63), -1)
    zero = F.lit(0)

    def each(make: Callable[[str], Callable], name: str) -> Stage:
        return {f"{name}{m}": make(m) for m in measures}

    known_start = ~F.col("_a") | (F.col("_prev") == F.lit(False))
    starts_here = F.col("_ptail").isNull() | ~F.col("_ptail")
    out = chunk_scan(
        rows, keys, [order], chunk,
        local=[
            {"_prev": lambda w: F.lag("_a").over(w), **each(lambda m: lambda w: F.coalesce(F.sum(f"_v_{m}").over(before(w)), zero), "_p_")},
            each(lambda m: lambda w: F.last(F.when(known_start, F.col(f"_p_{m}")), True).over(upto(w)), "_s_"),
        ],
        summary={
            "_tail": F.max_by("_a", order),
            **{f"_t_{m}": F.sum(f"_v_{m}") for m in measures},
            **{f"_e_{m}": F.max_by(f"_s_{m}", order) for m in measures},
        },
        carry=[
            {"_ptail": lambda w: F.lag("_tail").over(w), **each(lambda m: lambda w: F.coalesce(F.sum(f"_t_{m}").over(before(w)), zero), "_c_")},
            each(lambda m: lambda w: F.coalesce(F.col(f"_c_{m}") + F.col(f"_e_{m}"), F.when(starts_here, F.col(f"_c_{m}"))), "_own_"),
            {
                **each(lambda m: lambda w: F.when(starts_here, F.col(f"_c_{m}")).otherwise(F.last(f"_own_{m}", True).over(before(w))), "_open_"),
                **each(lambda m: lambda w: F.col(f"_c_{m}"), "_c_"),
            },
        ],
        scratch=["_prev", *[f"_p_{m}" for m in measures]],
    )
    out = out.withColumns({f"{prefix}{m}": F.coalesce(F.col(f"_c_{m}") + F.col(f"_s_{m}"), F.col(f"_open_{m}")) for m in measures})
    return out.drop("_a", *[f"{p}{m}" for p in ("_v_", "_s_", "_c_", "_open_") for m in measures])


def prompt_breakdown(ctx: DataFrame, drop_overflow: bool = False) -> DataFrame:
    """Reconcile the running context of assistant rows with the billed prompt tokens.

    The unexplained rest goes to thinking when hidden thinking was seen, else to other. More known
    than billed tokens sets ``overflow``; ``drop_overflow`` drops such rows.
    """
    known = sum((F.col(f"ctx_{b}") for b in BUCKETS), F.lit(0))
    tokens = ("input_tokens", "cache_write_tokens", "cache_read_tokens")
    billed = F.when(F.col("has_usage"), sum((F.coalesce(F.col(t), F.lit(0)) for t in tokens), F.lit(0)))
    rest = F.greatest(F.coalesce(billed - known, F.lit(0)), F.lit(0))
    hidden = F.col("ctx_hidden_thinking") > 0
    extra = {"thinking": F.when(hidden, rest).otherwise(0), "other": F.when(hidden, 0).otherwise(rest)}
    columns = {f"{b}_tokens": F.col(f"ctx_{b}") + extra.get(b, F.lit(0)) for b in BUCKETS}
    out = ctx.withColumns(
        {**columns, "total_tokens": F.coalesce(billed, known), "overflow": F.coalesce(known > billed, F.lit(False))}
    ).drop(*[f"ctx_{b}" for b in BUCKETS], "ctx_hidden_thinking")
    return out.filter(~F.col("overflow")) if drop_overflow else out


def _segments(df: DataFrame, keys: list[str], parts: dict[str, str], total: Column) -> DataFrame:
    """One row per non-zero segment of each key."""
    items = F.array(*[F.struct(F.lit(n).alias("segment"), F.col(c).cast("bigint").alias("tokens")) for n, c in parts.items()])
    rows = df.select(*keys, total.alias("total"), F.explode(items).alias("s"))
    return rows.select(*keys, "s.segment", "s.tokens", "total").filter("tokens > 0")


def usage_snapshot(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of each key split into input, cache read, output and cache write."""
    sums = usage.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in USAGE_SEGMENTS.values()])
    return _segments(sums, keys, USAGE_SEGMENTS, sum((F.col(c) for c in USAGE_SEGMENTS.values()), F.lit(0)))


def window_snapshot(breakdown: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Composition of the latest prompt: the last row of each key, one row per non-zero bucket."""
    names = [f"{b}_tokens" for b in BUCKETS]
    last = breakdown.groupBy(*keys).agg(F.max_by(F.struct("total_tokens", *names), order).alias("last"))
    rows = last.select(*keys, "last.*")
    return _segments(rows, keys, {b: f"{b}_tokens" for b in BUCKETS}, F.col("total_tokens"))
