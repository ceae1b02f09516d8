"""Price tables: the built-in list, price files and vendor registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.price_list import PRICE_LINES

PRICE = "decimal(12,8)"


def default_prices(spark: SparkSession) -> DataFrame:
    """The built-in list, one row per model, dollars per million tokens.

    Inline values, so the optimizer knows the exact size.
    """
    rows = []
    for line in PRICE_LINES.split("\n"):
        if line:
            model, provider, *prices = line.split(" ")
            cells = [f"'{model}'", f"'{provider}'", *[f"cast({p} as {PRICE})" for p in prices]]
            rows.append(f"({', '.join(cells)})")
    names = "model, provider, input_price, output_price, cache_write_price, cache_read_price"
    return spark.sql(f"select * from values {', '.join(rows)} as prices({names})")


def _entries(text: DataFrame, path: str) -> DataFrame:
    """(model, entry) rows of the JSON object at ``path`` in column ``value``."""
    parsed = text.select(
        F.expr(f"try_variant_get(try_parse_json(value), '{path}', 'map<string,variant>')").alias("m")
    )
    return parsed.select(F.explode("m").alias("model", "entry"))


def _number(name: str) -> str:
    return f"case when schema_of_variant(try_variant_get(entry,'$.{name}')) in ('BIGINT','DOUBLE') or schema_of_variant(try_variant_get(entry,'$.{name}')) like 'DECIMAL%' then try_variant_get(entry,'$.{name}','double') end"


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Read a price file ``{"models": {id: {provider, inputPerMillion, ...}}}``."""
    entries = _entries(spark.read.text(path, wholetext=True), "$.models")
    fields = {
        "input_price": "inputPerMillion",
        "output_price": "outputPerMillion",
        "cache_write_price": "cacheWritePerMillion",
        "cache_read_price": "cacheReadPerMillion",
    }
    return entries.select(
        "model",
        F.expr("try_variant_get(entry,'$.provider','string')").alias("provider"),
        *[
            F.expr(f"try_variant_get(entry,'$.{key}','decimal(12,8)')").alias(name)
            for name, key in fields.items()
        ],
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(model, entry) rows of a vendor registry file: one JSON object keyed by model id."""
    return _entries(spark.read.text(path, wholetext=True), "$")


def normalise_prices(registry: DataFrame) -> DataFrame:
    """Keep chat models of the two vendors and turn per-token into per-million prices.

    ``registry`` has ``model`` and a VARIANT ``entry``. Missing cache prices become 0.
    """
    model = F.col("model")
    provider = F.expr("try_variant_get(entry,'$.litellm_provider','string')")
    # Id parts of models that do not bill by text token.
    other_media = "audio|image|realtime|search|transcribe|tts"
    openai = (
        ~F.contains(model, F.lit("/"))
        & ~F.startswith(model, F.lit("ft:"))
        & ~model.rlike(other_media)
        & model.rlike(r"\A(gpt-|o\d)")
    )
    keep = ((provider == "anthropic") & F.startswith(model, F.lit("claude-"))) | (
        (provider == "openai") & openai
    )

    def per_million(name: str) -> Column:
        return F.round(F.expr(_number(name)) * 1_000_000, 8).cast(PRICE)

    zero = F.lit(0).cast(PRICE)
    return (
        registry.filter(keep)
        .select(
            "model",
            provider.alias("provider"),
            per_million("input_cost_per_token").alias("input_price"),
            per_million("output_cost_per_token").alias("output_price"),
            F.coalesce(per_million("cache_creation_input_token_cost"), zero).alias("cache_write_price"),
            F.coalesce(per_million("cache_read_input_token_cost"), zero).alias("cache_read_price"),
        )
        .filter("input_price is not null and output_price is not null")
        .orderBy("model")
    )
