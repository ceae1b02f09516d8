from __future__ import annotations

import pytest

from logloom.operators.pricing import cache_savings, match_prices, price_reference, price_usage, usd
from logloom.sources.prices import default_prices, read_prices
from pyspark.sql import functions as F

SCHEMA = "model string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long"
M = 1_000_000


def costs(spark, rows):
    df = price_usage(spark.createDataFrame(rows, SCHEMA), default_prices(spark))
    out = df.select("model", *[usd(F.col(f"micro_{m}")) for m in ("api", "conservative", "subscription")]).collect()
    return {r[0]: tuple(r[1:]) for r in out}


def test_million_tokens_in_all_modes(spark):
    got = costs(spark, [("claude-opus-4-7", M, M, M, M)])["claude-opus-4-7"]
    assert got == pytest.approx((36.75, 30.9625, 30.505))


def test_fallbacks(spark):
    names = ["claude-sonnet-4-6-20260504", "inhouse-haiku-7", "nameless-1", "", None]
    got = costs(spark, [(n, M, M, 0, 0) for n in names])
    assert [got[n][0] for n in names] == [18.0, 6.0, 0.0, 0.0, 0.0]


def test_dotted_ids_follow_the_prefix_unless_raw_ids_go_first(spark):
    models = spark.createDataFrame([("gpt-5.5",)], "model string")
    prices = default_prices(spark)
    assert match_prices(models, prices).first()["price_key"].startswith("gpt-5")
    assert match_prices(models, prices, raw_id_first=True).first()["price_key"] == "gpt-5.5"


def test_every_listed_id_without_dots_matches_itself(spark):
    prices = default_prices(spark)
    got = match_prices(prices.select("model").filter("model not like '%.%'"), prices)
    assert got.filter("model <> price_key").count() == 0
    assert got.count() == prices.filter("model not like '%.%'").count()


def test_price_file_and_reference_order(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"source":"s","models":{"claude-x-1":{"provider":"anthropic","inputPerMillion":3,"outputPerMillion":15.5,'
        '"cacheWritePerMillion":0,"cacheReadPerMillion":0.3},"gpt-9":{"provider":"openai","inputPerMillion":1,"outputPerMillion":2,'
        '"cacheWritePerMillion":0,"cacheReadPerMillion":0}}}'
    )
    rows = price_reference(read_prices(spark, str(tmp_path / "p.json"))).collect()
    assert [(r["model"], float(r["output_price"])) for r in rows] == [("claude-x-1", 15.5), ("gpt-9", 2.0)]


def test_cache_savings(spark):
    usage = spark.createDataFrame([("claude-opus-4-7", 0, 0, 0, M), ("nameless-1", 0, 0, 0, M)], SCHEMA)
    row = cache_savings(usage, default_prices(spark)).first()
    assert row["cache_read_tokens"] == 2 * M and float(row["micro_saved"]) == pytest.approx(4.5e6)
