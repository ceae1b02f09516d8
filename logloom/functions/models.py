"""Model id functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import trim_space

FAMILIES = ("opus", "sonnet", "haiku")


def model_display(model: Column) -> Column:
    """Family name for known families, otherwise the id itself."""
    low = F.lower(model)
    name = F.when(F.contains(low, F.lit("synthetic")), "Synthetic")
    for family in FAMILIES:
        name = name.when(F.contains(low, F.lit(family)), family.capitalize())
    return name.otherwise(model)


def normalise_model(model: Column) -> Column:
    """Lower case, vendor prefixes before the last ``claude-`` dropped, dots as dashes."""
    low = F.lower(trim_space(model))
    tail = F.when(F.contains(low, F.lit("claude-")), F.regexp_extract(low, r"(?s)\A.*(claude-.*)\z", 1))
    return F.translate(F.coalesce(tail, low), ".", "-")


def model_family(model: Column) -> Column:
    name = F.when(F.contains(model, F.lit(FAMILIES[0])), FAMILIES[0])
    for family in FAMILIES[1:]:
        name = name.when(F.contains(model, F.lit(family)), family)
    return name


def _version_part(part: Column) -> Column:
    usable = part.rlike(r"\A\d+\z") & ~part.rlike(r"\A\d{8}\z")
    return F.coalesce(F.when(usable, part.try_cast("bigint")), F.lit(0).cast("bigint"))


def version_rank(model: Column) -> Column:
    """struct(major, minor, date) read from a price-list id, newest highest."""
    parts = F.split(normalise_model(model), "-")
    at = F.array_position(parts, model_family(model))  # 1-based, 0 when absent
    major = F.when(at == 2, _version_part(F.get(parts, F.lit(2)))).when(
        at > 2, _version_part(F.get(parts, F.lit(1)))
    )
    minor = F.when(at == 2, _version_part(F.get(parts, F.lit(3)))).when(
        at == 4, _version_part(F.get(parts, F.lit(2)))
    )
    dates = F.transform(F.filter(parts, lambda p: p.rlike(r"\A\d{8}\z")), lambda p: p.cast("bigint"))
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.coalesce(major, zero).alias("major"),
        F.coalesce(minor, zero).alias("minor"),
        F.coalesce(F.array_max(dates), zero).alias("date"),
    )
