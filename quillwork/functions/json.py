"""JSON columns of uncertain shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_json_array(c: Column, element: str = "string") -> Column:
    """JSON array -> array of `element`; blank, malformed or not an array -> empty."""
    parsed = F.try_variant_get(F.try_parse_json(c), "$", f"array<{element}>")
    return F.coalesce(parsed, F.array().cast(f"array<{element}>"))


def decode_json_object(c: Column) -> Column:
    """JSON object -> variant; blank, malformed or not an object -> null."""
    parsed = F.try_parse_json(c)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def lenient_json(c: Column) -> Column:
    """Parse all, else the part between the first `{` and the last `}`, else `{}`."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(inner), F.parse_json(F.lit("{}")))


def object_items(v: Column, path: str) -> Column:
    """Array at `path` -> array<variant> of its objects; other elements are skipped."""
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def text_field(v: Column, name: str) -> Column:
    """Field as text; missing -> ''."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))


def number_field(v: Column, name: str) -> Column:
    """Field as double; missing or null -> 0."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "double"), F.lit(0.0))
