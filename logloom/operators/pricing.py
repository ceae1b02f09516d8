"""Price matching and cost columns.

Costs are kept as exact decimals in millionths of a dollar (``micro_*``). Token counts are summed
as integers first and priced afterwards, so no result depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.models import model_display, model_family, normalise_model, version_rank
from logloom.session import cut_lineage

MODES = ("api", "conservative", "subscription")
DEFAULT_MODE = "subscription"
TOKENS = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")
MICRO = [f"micro_{mode}" for mode in MODES]
COST = [f"cost_{mode}" for mode in MODES]

# Share of the list price charged for cache writes and cache reads.
CACHE_SHARES = {"api": ("1.00", "1.00"), "conservative": ("0.15", "0.05"), "subscription": ("0.08", "0.01")}

_PRICES = ("input_price", "output_price", "cache_write_price", "cache_read_price")


def _rank(key: Column) -> Column:
    """Sort key of a price row; the smallest wins: newest version, then longest id, then name."""
    version = version_rank(key)
    return F.struct(
        (-version["major"]).alias("major"),
        (-version["minor"]).alias("minor"),
        (-version["date"]).alias("date"),
        (-F.length(key)).alias("width"),
        key.alias("key"),
    )


def _dash_prefixes(text: Column) -> Column:
    """All proper prefixes that end before a dash."""
    parts = F.split(text, "-")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), "-")),
    )


def match_prices(models: DataFrame, prices: DataFrame, raw_id_first: bool = False) -> DataFrame:
    """One row per distinct ``model`` that has a price: the price row that applies.

    Tiers: same id, then either id a dash-prefix of the other, then the same family. Each tier is an
    equi-join on a probe string, so neither side is broadcast and no pair table is built. With
    ``raw_id_first`` an id that is literally in the list wins over its normalised form.
    """
    key = F.col("model")
    probes = [
        F.struct(F.lit(1).alias("tier"), F.array(key).alias("names")),
        F.struct(F.lit(2).alias("tier"), F.array(key).alias("names")),
        F.struct(F.lit(3).alias("tier"), _dash_prefixes(key).alias("names")),
        F.struct(F.lit(4).alias("tier"), F.array(model_family(key)).alias("names")),
    ]
    if raw_id_first:
        probes.append(F.struct(F.lit(0).alias("tier"), F.array(key).alias("names")))
    catalog = (
        prices.select(_rank(key).alias("rank"), F.array(*probes).alias("probes"))
        .select("rank", F.explode("probes").alias("p"))
        .select("rank", "p.tier", F.explode("p.names").alias("probe"))
        .filter("probe is not null")
        .groupBy("tier", "probe")
        .agg(F.min("rank").alias("rank"))
    )

    wanted = models.select("model").distinct().withColumn("id", normalise_model(key))
    probes = F.array(
        F.struct(F.lit(1).alias("tier"), F.array(F.col("id")).alias("names")),
        F.struct(F.lit(2).alias("tier"), _dash_prefixes(F.col("id")).alias("names")),
        F.struct(F.lit(3).alias("tier"), F.array(F.col("id")).alias("names")),
        F.struct(F.lit(4).alias("tier"), F.array(model_family(F.col("id"))).alias("names")),
    )
    if raw_id_first:
        probes = F.concat(probes, F.array(F.struct(F.lit(0).alias("tier"), F.array(key).alias("names"))))
    asked = (
        wanted.select("model", F.explode(probes).alias("p"))
        .select("model", "p.tier", F.explode("p.names").alias("probe"))
        .filter("probe is not null")
    )
    # The two prefix directions compete in one tier.
    tier = F.when(F.col("tier") == 3, 2).otherwise(F.col("tier"))
    best = (
        asked.join(catalog, ["tier", "probe"])
        .groupBy("model")
        .agg(F.min(F.struct(tier.alias("tier"), "rank")).alias("best"))
        .select("model", F.col("best.rank.key").alias("price_key"))
    )
    named = prices.withColumnRenamed("model", "price_key")
    return best.join(named, "price_key")


def bounded(matched: DataFrame, most: int = 10_000) -> DataFrame:
    """Matched prices as a local table with a broadcast hint if they are few; a large table is written and joined by a shuffle."""
    rows = matched.limit(most + 1).collect()
    if len(rows) > most:
        return cut_lineage(matched)
    return F.broadcast(matched.sparkSession.createDataFrame(rows, matched.schema))


def match_used(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """The prices of the models in ``usage``, matched once for several calls that take ``matched``."""
    return bounded(match_prices(usage.select("model").distinct(), prices))


def with_costs(df: DataFrame, matched: DataFrame) -> DataFrame:
    """Add ``micro_*`` for token sums per ``model``; models without a price cost 0."""
    priced = df.join(matched.select("model", *_PRICES), "model", "left")
    amount = {
        t: F.coalesce(F.col(t), F.lit(0)).cast("decimal(18,0)") * F.col(p) for t, p in zip(TOKENS, _PRICES)
    }
    base = amount["input_tokens"] + amount["output_tokens"]
    zero = F.lit(0).cast("decimal(38,10)")
    columns = {}
    for mode, (write, read) in CACHE_SHARES.items():
        cost = (
            base
            + amount["cache_write_tokens"] * F.expr(f"{write}BD")
            + amount["cache_read_tokens"] * F.expr(f"{read}BD")
        )
        columns[f"micro_{mode}"] = F.coalesce(cost.cast("decimal(38,10)"), zero)
    return priced.withColumns(columns).drop(*_PRICES)


def sum_micro() -> list[Column]:
    return [F.sum(c).cast("decimal(38,10)").alias(c) for c in MICRO]


def usd(micro: Column) -> Column:
    return micro.cast("double") / F.lit(1e6)


def usd_rounded(micro: Column, digits: int = 4) -> Column:
    """Dollars rounded half up to ``digits`` (at most 6) from exact millionths."""
    step = 10 ** (6 - digits)
    units = F.floor((F.floor(micro).cast("bigint") + F.lit(step // 2)) / F.lit(step))
    return units.cast("double") / F.lit(float(10**digits))


def costs_rounded(digits: int = 4) -> list[Column]:
    return [usd_rounded(F.col(m), digits).alias(c) for m, c in zip(MICRO, COST)]


def pick_cost(mode: str | None = None) -> Column:
    """The ``micro_*`` column of a mode; unknown or missing modes fall back to the default."""
    chosen = mode if mode in MODES else DEFAULT_MODE
    return F.coalesce(F.col(f"micro_{chosen}"), F.col(f"micro_{DEFAULT_MODE}"))


def price_usage(usage: DataFrame, prices: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Match the models that occur in ``usage`` and add the cost columns.

    ``usage`` should be aggregated: it is written once, as the match and the costs both read it, unless ``matched`` (of
    :func:`match_used`) is given. No row of it moves when the matched prices are few.
    """
    if matched is not None:
        return with_costs(usage, matched)
    usage = cut_lineage(usage)
    return with_costs(usage, match_used(usage, prices))


def cache_savings(model_usage: DataFrame, prices: DataFrame) -> DataFrame:
    """What cache reads would have cost as plain input, minus what they cost (one row)."""
    model_usage = cut_lineage(model_usage)
    priced = model_usage.join(match_used(model_usage, prices), "model", "left")
    tokens = F.col("cache_read_tokens").cast("decimal(18,0)")
    saved = tokens * (F.col("input_price") - F.col("cache_read_price"))
    zero = F.lit(0).cast("decimal(38,10)")
    return priced.agg(
        F.sum("cache_read_tokens").alias("cache_read_tokens"),
        F.coalesce(F.sum(saved.cast("decimal(38,10)")).cast("decimal(38,10)"), zero).alias("micro_saved"),
    )


def cost_by_project(projects: DataFrame, mode: str | None = None, top: int = 10) -> DataFrame:
    """The projects that cost most in one mode, dollars to the cent."""
    return (
        projects.select("project_id", pick_cost(mode).alias("micro"))
        .filter("micro > 0")
        .orderBy(F.desc("micro"), "project_id")
        .limit(top)
        .select("project_id", usd_rounded(F.col("micro"), 2).alias("cost"))
    )


def cost_by_model(model_usage: DataFrame, mode: str | None = None) -> DataFrame:
    """Token sums and cost per model; ``model_usage`` carries ``micro_*``."""
    return model_usage.select(
        "model", model_display(F.col("model")).alias("display_name"), *TOKENS,
        usd_rounded(pick_cost(mode)).alias("cost"),
    )


def price_reference(prices: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Price rows in display order, optionally only those that apply to ``models``."""
    rows = prices
    if models is not None:
        keys = match_prices(models, prices).select(F.col("price_key").alias("model")).distinct()
        rows = prices.join(keys, "model", "left_semi")
    provider_order = F.when(F.col("provider") == "anthropic", 0).when(F.col("provider") == "openai", 1)
    return rows.orderBy(F.coalesce(provider_order, F.lit(99)), _rank(F.col("model")))


def daily_cost_wide(daily: DataFrame, mode: str | None = None, names: list[str] | None = None) -> DataFrame:
    """One row per day, one column per display name, missing = 0, dollars to the cent.

    ``daily`` has date, model and ``micro_*``. With ``names`` the extra pass that lists them is skipped, and the column
    ``other`` keeps the cost of all further names.
    """
    name = model_display(F.col("model"))
    if names:
        name = F.when(name.isin(names), name).otherwise("other")
    named = daily.select("date", name.alias("name"), pick_cost(mode).alias("micro"))
    grouped = named.groupBy("date").pivot("name", [*names, "other"]) if names else named.groupBy("date").pivot("name")
    wide = grouped.agg(F.sum("micro").cast("decimal(38,10)"))
    zero = F.lit(0).cast("decimal(38,10)")
    return wide.select(
        "date", *[usd_rounded(F.coalesce(F.col(f"`{c}`"), zero), 2).alias(c) for c in wide.columns[1:]]
    )


def allocate_costs(base_daily: DataFrame, model_usage: DataFrame) -> DataFrame:
    """Cost of days known only by token count: the model's cost per token times the tokens.

    ``base_daily`` has date, model, tokens; ``model_usage`` has the four counters and ``micro_*``.
    """
    total = sum((F.col(t) for t in TOKENS), F.lit(0))
    ratio = model_usage.select("model", total.alias("model_tokens"), *MICRO).filter("model_tokens > 0")
    zero = F.lit(0).cast("decimal(38,10)")
    share = [
        F.coalesce(
            F.round(
                F.col("tokens").cast("double")
                * (F.col(m).cast("double") / F.col("model_tokens").cast("double")),
                4,
            ).cast("decimal(38,10)"),
            zero,
        ).alias(m)
        for m in MICRO
    ]
    return base_daily.join(ratio, "model", "left").select("date", "model", "tokens", *share)
