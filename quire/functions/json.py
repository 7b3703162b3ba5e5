"""Strict JSON on top of VARIANT, and tests on its values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_parse(text: Column) -> Column:
    """VARIANT of ``text`` when the whole text is one JSON value, else null.

    ``try_parse_json`` ignores text after the first value. Such text would have to continue an array
    and an object at once to pass both wrapped forms, which no text can.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    guard = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(guard.isNotNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def as_field_map(data: Column) -> Column:
    """Top-level keys of an object VARIANT; null when it is not an object."""
    return data.try_cast("map<string,variant>")


def is_object_text(text: Column) -> Column:
    """Whether JSON text holds an object: its first character after JSON white space tells."""
    return F.ltrim(text, F.lit(" \t\r\n")).startswith("{")


def is_filled(value: Column) -> Column:
    """Neither null nor an empty string; 0, false, [] and {} count as filled.

    Lists and objects are recognised by a shallow cast, so their contents are never turned into text.
    """
    nested = value.try_cast("array<variant>").isNotNull() | value.try_cast("map<string,variant>").isNotNull()
    return ~F.is_variant_null(value) & (nested | F.coalesce(value.try_cast("string") != "", F.lit(True)))
