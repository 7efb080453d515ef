"""Instants as ``timestamp_ntz``, without ever going through the session's time zone.

Spark computes differences and truncations of such columns in the session zone, where a clock
change would shift them; the functions here do not.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def instant(value: dt.datetime | str) -> Column:
    """A UTC instant, whatever the zones of session and driver."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def midnight(at: Column) -> Column:
    return F.to_date(at).cast("timestamp_ntz")


def start_of(unit: str, at: Column) -> Column:
    """Start of the month or year."""
    return F.trunc(F.to_date(at), unit).cast("timestamp_ntz")


def start_of_hour(at: Column) -> Column:
    return F.timestamp_add("HOUR", F.hour(at), midnight(at))


def month_text(at: Column) -> Column:
    return F.substring(at.cast("string"), 1, 7)


def compact_text(at: Column) -> Column:
    """``yyyyMMdd_HHmmss``."""
    return F.regexp_replace(
        F.translate(F.substring(at.cast("string"), 1, 19), "-:", ""), " ", "_"
    )


def millis_between(start: Column, end: Column) -> Column:
    gap = end - start

    def part(name: str) -> Column:
        return F.extract(F.lit(name), gap)

    minutes = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes.cast("bigint") * 60000 + (part("SECOND") * 1000).cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, towards zero."""
    return (millis_between(start, end) / 1000).cast("bigint")


def epoch_millis(at: Column) -> Column:
    return millis_between(instant("1970-01-01 00:00:00"), at)


def utc_of_iso(text: Column) -> Column:
    """ISO text as UTC: ``Z`` and offsets are honoured, text without one is UTC already; null if bad."""
    wall = text.try_cast("timestamp_ntz")
    offset = r"([+-])(\d{2})(?::?(\d{2}))?$"
    sign = F.regexp_extract(text, offset, 1)
    hours = F.regexp_extract(text, offset, 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(text, offset, 3).try_cast("int"), F.lit(0))
    has_time = text.contains(":")
    shift = F.when(has_time & (sign != ""), hours * 60 + minutes).otherwise(0)
    return F.timestamp_add("MINUTE", F.when(sign == "+", -shift).otherwise(shift), wall)
