"""Typed access to loosely typed JSON values held as VARIANT.

A VARIANT sorts object keys, so where document order matters the JSON text travels along.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NUMBER = r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL)"


class Doc(NamedTuple):
    """One JSON value as VARIANT and as text (the text keeps key order)."""

    value: Column
    text: Column

    def child(self, name: str) -> "Doc":
        return Doc(get(self.value, name), F.get_json_object(self.text, f"$.{name}"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select(*columns)`` behind a generator, so that no later filter repeats the columns' work."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("_row")).select("_row.*")


def get(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def is_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def scalar_kind(value: Column) -> Column:
    """Type name of a scalar, NULL for objects and arrays, whose full schema would be costly to derive."""
    return F.when(~is_object(value) & ~is_array(value), F.schema_of_variant(value))


def kind_at(value: Column, name: str) -> Column:
    """Type name of a field that is normally a scalar, NULL where it is absent."""
    return F.schema_of_variant(get(value, name))


def is_string(value: Column) -> Column:
    return F.coalesce(scalar_kind(value) == "STRING", F.lit(False))


def is_boolean(value: Column) -> Column:
    return F.coalesce(scalar_kind(value) == "BOOLEAN", F.lit(False))


def is_number(value: Column) -> Column:
    return F.coalesce(scalar_kind(value).rlike(NUMBER), F.lit(False))


def is_null(value: Column) -> Column:
    """Absent or JSON null."""
    return value.isNull() | F.is_variant_null(value)


def as_string(value: Column) -> Column:
    """The text of any scalar."""
    return F.try_variant_get(value, "$", "string")


def string_at(value: Column, name: str) -> Column:
    """Text of a field if it is a JSON string, otherwise NULL."""
    return F.when(kind_at(value, name) == "STRING", get(value, name, "string"))


def number_at(value: Column, name: str) -> Column:
    """Whole number of a numeric field, otherwise NULL."""
    return F.when(kind_at(value, name).rlike(NUMBER), get(value, name, "double").try_cast("bigint"))


def items(value: Column) -> Column:
    """Elements of an array, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def entries(doc: Doc) -> Column:
    """Fields of an object in document order: array<struct(key, text, value)>."""
    texts = F.map_entries(F.from_json(doc.text, "map<string,string>"))

    def paired(by_name: Column) -> Column:
        return F.transform(
            texts,
            lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text"), F.try_element_at(by_name, e["key"]).alias("value")),
        )

    return let(fields(doc.value), paired)


def elements(doc: Doc) -> Column:
    """Elements of an array in order: array<struct(text, value)>."""
    def paired(texts: Column) -> Column:
        return F.transform(items(doc.value), lambda v, i: F.struct(F.get(texts, i).alias("text"), v.alias("value")))

    return F.when(is_array(doc.value), let(F.from_json(doc.text, "array<string>"), paired))


def flatten(doc: Doc) -> Column:
    """Dotted keys of a nested object, at most three parts; nulls dropped, arrays kept whole.

    array<struct(key, value)> in document order.
    """

    def level(d: Doc, prefix: Column | None, depth: int) -> Column:
        def one(e: Column) -> Column:
            key = e["key"] if prefix is None else F.concat_ws(".", prefix, e["key"])
            leaf = F.array(F.struct(key.alias("key"), e["value"].alias("value")))
            if depth == 2:
                return leaf
            return F.when(is_object(e["value"]), level(Doc(e["value"], e["text"]), key, depth + 1)).otherwise(leaf)

        return F.flatten(F.transform(F.filter(entries(d), lambda e: ~is_null(e["value"])), one))

    return level(doc, None, 0)


def first_of(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(array, test), F.lit(0))
