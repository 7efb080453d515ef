"""Cron text in the grammar the schedules use: ``0 H * * *``, ``0 H * * D``, ``0 H M * *``.

Minutes are ignored: every run starts on the hour. Lists, ranges and steps give null, so the
caller can report the row as unparsed.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _field(cron: Column, position: int, low: int, high: int, at_least: int) -> Column:
    parts = F.split(F.trim(cron), r"\s+")
    value = F.try_element_at(parts, F.lit(position)).try_cast("int")
    return F.when((F.size(parts) >= at_least) & value.between(low, high), value)


def cron_hour(cron: Column, at_least: int = 5) -> Column:
    return _field(cron, 2, 0, 23, at_least)


def cron_day_of_month(cron: Column, at_least: int = 5) -> Column:
    return _field(cron, 3, 1, 31, at_least)


def cron_day_of_week(cron: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return _field(cron, 5, 0, 6, 5)


def weekday_of_cron_day(day_of_week: Column) -> Column:
    """Cron day (0 = Sunday) to weekday (0 = Monday)."""
    return F.pmod(day_of_week - 1, F.lit(7))


def cron_day_of_weekday(weekday: Column) -> Column:
    """Weekday (0 = Monday) to cron day (0 = Sunday)."""
    return F.pmod(weekday + 1, F.lit(7))


def cron_text(schedule_type: Column, at: Column) -> Column:
    """The cron text of a schedule that runs at the hour (and day) of ``at``."""
    hour = F.hour(at).cast("string")
    return (
        F.when(schedule_type == "daily", F.concat(F.lit("0 "), hour, F.lit(" * * *")))
        .when(
            schedule_type == "weekly",
            F.concat(
                F.lit("0 "),
                hour,
                F.lit(" * * "),
                cron_day_of_weekday(F.weekday(at)).cast("string"),
            ),
        )
        .when(
            schedule_type == "monthly",
            F.concat(F.lit("0 "), hour, F.lit(" "), F.day(at).cast("string"), F.lit(" * *")),
        )
    )
