"""W3C ``traceparent`` values in columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Four parts, the second 32 and the third 16 characters long.
_SHAPE = r"^\s*[^-]*-[^-]{32}-[^-]{16}-[^-]*$"


def is_traceparent(traceparent: Column) -> Column:
    return F.coalesce(traceparent.rlike(_SHAPE), F.lit(False))


def header_value(headers: Column, name: str) -> Column:
    """The first header of that name, as text; null when it is not valid UTF-8."""
    match = F.try_element_at(F.filter(headers, lambda h: h["key"] == name), F.lit(1))
    return F.try_validate_utf8(match["value"].cast("string"))


def traceparent_or_new(traceparent: Column, *identity: Column) -> Column:
    """The value if valid, else a new one derived from the record's identity.

    Deriving it keeps the id the same when a lost task is computed again.
    """
    key = F.concat_ws(":", *[c.cast("string") for c in identity])
    made = F.concat(
        F.lit("00-"),
        F.md5(key),
        F.lit("-"),
        F.substring(F.md5(F.concat(F.lit("span:"), key)), 1, 16),
        F.lit("-01"),
    )
    return F.when(is_traceparent(traceparent), F.trim(traceparent)).otherwise(made)


def trace_id(traceparent: Column) -> Column:
    """Lenient: the second part of anything with two parts."""
    return F.try_element_at(F.split(traceparent, "-"), F.lit(2))
