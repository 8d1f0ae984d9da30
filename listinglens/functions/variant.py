"""Defensive reads of VARIANT values: a missing or odd field gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(payload: Column) -> Column:
    return F.try_parse_json(payload)


def field(value: Column, path: str) -> Column:
    """Sub-value at ``path`` (``"a.b"``), null when absent or JSON null."""
    got = F.try_variant_get(value, f"$.{path}", "variant")
    return F.when(~F.is_variant_null(got), got)


def fields(value: Column, **paths: str) -> list[Column]:
    """Named sub-values to select ahead of the rules that look at them several times."""
    return [field(value, path).alias(name) for name, path in paths.items()]


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    shape = kind(value)
    return shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def first_of(*values: Column) -> Column:
    return F.coalesce(*values)


def text(value: Column) -> Column:
    """The string, only when the value is one."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def full_text(value: Column) -> Column:
    """The string when it is one and not empty."""
    got = text(value)
    return F.when(got != "", got)


def as_text(value: Column) -> Column:
    """Any scalar as text (ids come as numbers or strings)."""
    return F.try_variant_get(value, "$", "string")


def number(value: Column) -> Column:
    """The number, only when the value is one and finite."""
    got = F.when(is_number(value), F.try_variant_get(value, "$", "double"))
    return F.when((F.abs(got) < F.lit(float("inf"))) & ~F.isnan(got), got)


def digits_to_number(text_value: Column) -> Column:
    """All non-digits removed ("50.08" gives 5008, a sign is lost); null without digits."""
    digits = F.regexp_replace(text_value, "[^0-9]", "")
    return F.when(digits != "", digits).try_cast("double")


def loose_number(value: Column) -> Column:
    """A JSON number as it is, a string by :func:`digits_to_number`."""
    return F.coalesce(number(value), digits_to_number(text(value)))


def truthy(value: Column) -> Column:
    """JavaScript truth of a JSON value; absent is false."""
    shape = kind(value)
    return F.coalesce(
        F.when(shape == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(is_number(value), F.try_variant_get(value, "$", "double") != 0)
        .when(shape == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(value.isNotNull(), F.lit(True)),
        F.lit(False),
    )


def is_true(value: Column) -> Column:
    """Exactly the JSON literal ``true``."""
    return F.coalesce(
        F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")), F.lit(False)
    )


def items(value: Column) -> Column:
    """Elements when the value is an array, else null."""
    return F.try_variant_get(value, "$", "array<variant>")
