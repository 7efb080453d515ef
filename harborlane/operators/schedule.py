"""Schedules: normalising them on create and update, and advancing them after a run.

All of it is column arithmetic on local time, so one pass handles every tenant and zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harborlane import schemas
from harborlane.functions import cron, zones
from harborlane.functions.times import midnight, start_of


def _plus(unit: str, n: Column | int, at: Column) -> Column:
    return F.timestamp_add(unit, F.lit(n) if isinstance(n, int) else n, at)


def _daily_after(base: Column, hour: Column) -> Column:
    today = _plus("HOUR", hour, midnight(base))
    return F.when(today > base, today).otherwise(_plus("DAY", 1, today))


def _weekly_after(base: Column, hour: Column, day_of_week: Column) -> Column:
    ahead = F.pmod(cron.weekday_of_cron_day(day_of_week) - F.weekday(base), F.lit(7))
    first = _plus("HOUR", hour, _plus("DAY", ahead.cast("int"), midnight(base)))
    return F.when(first > base, first).otherwise(_plus("DAY", 7, first))


def _monthly_after(base: Column, hour: Column, day_of_month: Column) -> Column:
    """The next month that has the day; never more than two months ahead."""
    start = start_of("month", base)

    def in_month(ahead: int) -> Column:
        first = _plus("MONTH", ahead, start)
        at = _plus("HOUR", hour, _plus("DAY", (day_of_month - 1).cast("int"), first))
        return F.when((F.day(F.last_day(first)) >= day_of_month) & (at > base), at)

    return F.coalesce(in_month(0), in_month(1), in_month(2))


def next_after(
    base: Column, schedule_type: Column, hour: Column, day_of_week: Column, day_of_month: Column
) -> Column:
    """First occurrence strictly after ``base`` on the same clock; null if a field is missing."""
    return (
        F.when(schedule_type == "daily", _daily_after(base, hour))
        .when(schedule_type == "weekly", _weekly_after(base, hour, day_of_week))
        .when(schedule_type == "monthly", _monthly_after(base, hour, day_of_month))
    )


def with_schedule_fields(df: DataFrame, cron_column: str = "usr_sch_cron") -> DataFrame:
    text = F.col(cron_column)
    return df.withColumns(
        {
            "cron_hour": cron.cron_hour(text),
            "cron_dow": cron.cron_day_of_week(text),
            "cron_dom": cron.cron_day_of_month(text),
        }
    )


def _with_zone(df: DataFrame) -> DataFrame:
    return df.withColumn("usr_timezone", F.coalesce("usr_timezone", F.lit("UTC")))


def _with_next_run(df: DataFrame, name: str, base: Column, zone: Column) -> DataFrame:
    """Add the next run of the parsed schedule after ``base`` (UTC), as UTC.

    Taken on the local clock of ``zone``, moved out of a gap, then converted; null without a zone.
    Each step is a column of its own, because the next step uses it several times.
    """
    kind = F.col("schedule_type")
    return (
        df.withColumn("_zone", zone)
        .withColumn("_base", zones.from_utc(base, F.col("_zone")))
        .withColumn(
            "_local",
            next_after(
                F.col("_base"), kind, F.col("cron_hour"), F.col("cron_dow"), F.col("cron_dom")
            ),
        )
        .withColumn("_start", zones.repair_gap(F.col("_local"), F.col("_zone")))
        .withColumn(name, zones.to_utc(F.col("_start"), F.col("_zone")))
        .drop("_zone", "_base", "_local", "_start")
    )


def normalise(integrations: DataFrame, now: Column) -> DataFrame:
    """Set ``utc_next_run`` and ``utc_sch_cron`` from the local schedule, and ``sch_error``.

    Rows without a timed schedule get nulls and no error. A bad zone, unparsed cron text or a
    missing day is an error and leaves both columns null.
    """
    kind = F.col("schedule_type")
    timed = (F.coalesce(F.col("usr_sch_cron"), F.lit("")) != "") & kind.isin(
        schemas.TIMED_SCHEDULES
    )
    error = (
        F.when(~zones.is_known_zone("usr_timezone"), F.lit("invalid timezone"))
        .when(~timed, F.lit(None))
        .when(F.col("cron_hour").isNull(), F.lit("unparsed cron"))
        .when((kind == "weekly") & F.col("cron_dow").isNull(), F.lit("missing weekday"))
        .when((kind == "monthly") & F.col("cron_dom").isNull(), F.lit("missing day of month"))
    )
    checked = (
        with_schedule_fields(_with_zone(integrations))
        .withColumn("sch_error", error)
    )
    readable = F.when(timed & F.col("sch_error").isNull(), F.col("usr_timezone"))
    return (
        _with_next_run(checked, "utc_next_run", now, readable)
        .withColumn("utc_sch_cron", cron.cron_text(kind, F.col("utc_next_run")))
        .drop("cron_hour", "cron_dow", "cron_dom")
    )


def apply_updates(integrations: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Merge partial updates and recompute the schedule where schedule or zone was touched.

    ``updates`` has ``integration_id``, any columns of the table, and ``changed``, an array of
    the names that are set; a set column may hold null.
    """
    settable = [c for c in updates.columns if c not in ("integration_id", "changed")]
    new = updates.select(
        "integration_id", "changed", *[F.col(c).alias(f"_new_{c}") for c in settable]
    )
    joined = integrations.join(new, "integration_id", "left")

    def touched(name: str) -> Column:
        return F.coalesce(F.array_contains("changed", name), F.lit(False))

    merged = joined.withColumns(
        {c: F.when(touched(c), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in settable}
    )
    again = (
        (touched("usr_sch_cron") | touched("usr_timezone") | touched("schedule_type"))
        & (F.coalesce(F.col("usr_sch_cron"), F.lit("")) != "")
        & (F.col("schedule_type") != "on_demand")
    )
    kept = merged.select(
        *integrations.columns, again.alias("_again"), F.col("changed").isNotNull().alias("_hit")
    ).withColumns({"_old_run": F.col("utc_next_run"), "_old_cron": F.col("utc_sch_cron")})
    fresh = normalise(kept, now)
    return fresh.select(
        *[
            F.when(F.col("_again"), F.col("utc_next_run")).otherwise(F.col("_old_run")).alias(c)
            if c == "utc_next_run"
            else F.when(F.col("_again"), F.col("utc_sch_cron")).otherwise(F.col("_old_cron")).alias(c)
            if c == "utc_sch_cron"
            else F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in integrations.columns
        ],
        F.when(F.col("_again"), F.col("sch_error")).alias("sch_error"),
    )


def with_advanced_run(
    df: DataFrame,
    now: Column,
    frozen_offset: bool = False,
    name: str = "advanced_run",
    due: Column | None = None,
) -> DataFrame:
    """Add the run after a dispatch: daily from now, weekly and monthly from the run just taken.

    ``frozen_offset`` advances the stored UTC text; otherwise the local schedule is used, so the
    local hour survives a clock change. A schedule that cannot be read keeps its time, and so does
    one that is not ``due``, whose zone is never looked at.
    """
    kind, current = F.col("schedule_type"), F.col("utc_next_run")
    base = F.when(kind.isin("weekly", "monthly"), F.coalesce(current, now)).otherwise(now)
    if frozen_offset:
        zone, text = F.lit("UTC"), "utc_sch_cron"
    else:
        df, zone, text = _with_zone(df), zones.known_zone("usr_timezone"), "usr_sch_cron"
    if due is not None:
        zone = F.when(due, zone)
    following = _with_next_run(with_schedule_fields(df, text), name, base, zone)
    return following.withColumn(name, F.coalesce(F.col(name), current)).drop(
        "cron_hour", "cron_dow", "cron_dom"
    )


def advance(
    integrations: DataFrame, due: Column, now: Column, frozen_offset: bool = False
) -> DataFrame:
    """The table with the due rows moved to their next run."""
    return (
        with_advanced_run(integrations, now, frozen_offset, "_advanced", due)
        .withColumn("utc_next_run", F.col("_advanced"))
        .drop("_advanced")
    )
