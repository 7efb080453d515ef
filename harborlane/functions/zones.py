"""Daylight-saving-aware time functions over a zone column.

Local and UTC times are ``timestamp_ntz``. ``convert_timezone`` takes the offset before the
change both for a time in a gap and for the first pass of an overlap, which is the default the
schedules want; the other cases are built from it. A zone outside the known names gives null,
never an error, because Spark would fail the whole job on it.
"""

from __future__ import annotations

import zoneinfo
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harborlane.functions.times import instant, seconds_between, start_of



@cache
def zone_names() -> tuple[str, ...]:
    """Zone names known to both the zone database and the JVM; a fixed list of some 600 names."""
    jvm = SparkContext.getOrCreate()._jvm
    in_jvm = set(jvm.java.time.ZoneId.getAvailableZoneIds())
    return tuple(sorted(zoneinfo.available_timezones() & in_jvm))


def is_known_zone(column: str) -> Column:
    """Whether the named column holds a valid zone; one hash lookup per row."""
    names = ", ".join(f"'{name}'" for name in zone_names())
    return F.coalesce(F.expr(f"`{column}` in ({names})"), F.lit(False))


def known_zone(column: str) -> Column:
    """The zone of the named column if it is valid, else null."""
    return F.when(is_known_zone(column), F.col(column))


def _shift(zone_from: Column, zone_to: Column, at: Column) -> Column:
    return F.convert_timezone(zone_from, zone_to, at)


def from_utc(at: Column, zone: Column) -> Column:
    return _shift(F.lit("UTC"), zone, at)


def _first_utc(local: Column, zone: Column) -> Column:
    return _shift(zone, F.lit("UTC"), local)


def _offset(local: Column, zone: Column) -> Column:
    return local - _first_utc(local, zone)


def _later_offset(local: Column, zone: Column) -> Column:
    """Offset a few hours on: the one after the change when ``local`` is in an overlap."""
    later = _first_utc(local, zone) + F.expr("interval 3 hours")
    return from_utc(later, zone) - later


def is_ambiguous(local: Column, zone: Column) -> Column:
    """True where the clock shows ``local`` twice."""
    after = _later_offset(local, zone)
    return (_offset(local, zone) > after) & (from_utc(local - after, zone) == local)


def to_utc(local: Column, zone: Column, second: bool | Column = False) -> Column:
    """Local to UTC; ``second`` picks the second pass of an overlap."""
    first = _first_utc(local, zone)
    if second is False:
        return first
    wanted = F.lit(True) if second is True else second
    return F.when(
        wanted & is_ambiguous(local, zone), local - _later_offset(local, zone)
    ).otherwise(first)


def is_nonexistent(local: Column, zone: Column) -> Column:
    """True where the clock skips ``local``."""
    return from_utc(_first_utc(local, zone), zone) != local


def repair_gap(local: Column, zone: Column, strategy: str = "shift_forward") -> Column:
    """Move a skipped time out of its gap by an hour, or to the nearest minute within two hours.

    With ``raise`` the result is null for a skipped time and the caller reports it.
    """
    if strategy == "raise":
        return F.when(~is_nonexistent(local, zone), local)
    if strategy not in ("shift_forward", "shift_backward"):
        raise ValueError(f"unknown strategy {strategy}")
    sign = 1 if strategy == "shift_forward" else -1

    def moved(minutes: Column) -> Column:
        return F.timestamp_add("MINUTE", minutes * sign, local)

    hour = moved(F.lit(60))
    minutes = F.try_element_at(
        F.filter(F.sequence(F.lit(1), F.lit(119)), lambda m: ~is_nonexistent(moved(m), zone)),
        F.lit(1),
    )
    return (
        F.when(~is_nonexistent(local, zone), local)
        .when(~is_nonexistent(hour, zone), hour)
        .otherwise(F.coalesce(moved(minutes), local))
    )


def offset_hours(local: Column, zone: Column) -> Column:
    seconds = seconds_between(_first_utc(local, zone), local)
    return seconds / F.lit(3600.0)


def is_dst(local: Column, zone: Column) -> Column:
    """True where the offset differs from the smaller of the January and July offsets."""
    january = start_of("year", local)
    july = F.timestamp_add("MONTH", F.lit(6), january)
    standard = F.least(offset_hours(january, zone), offset_hours(july, zone))
    return offset_hours(local, zone) != standard


def dst_transitions(zones: DataFrame, year: int, zone: str = "zone") -> DataFrame:
    """The days of a year on which each zone enters and leaves daylight saving.

    Probes local noon of every day, as UTC instants of the first noon after the change. Each
    zone makes 366 rows, so a window per zone is small whatever the input size.
    """
    days = F.sequence(F.lit(0), F.lit(365))
    start = instant(f"{year}-01-01 12:00:00")
    z = F.col(zone)
    probes = (
        zones.select(known_zone(zone).alias(zone))
        .where(z.isNotNull())
        .distinct()
        .select(zone, F.explode(days).alias("d"))
        .withColumn("noon", F.timestamp_add("DAY", F.col("d"), start))
        .withColumn("dst", is_dst(F.col("noon"), z))
    )
    before = F.lag("dst").over(W.partitionBy(zone).orderBy("d"))
    flips = probes.withColumn("was", before).withColumn("utc", to_utc(F.col("noon"), z))
    return flips.groupBy(zone).agg(
        F.max(F.when(~F.col("was") & F.col("dst"), F.col("utc"))).alias("spring_forward"),
        F.max(F.when(F.col("was") & ~F.col("dst"), F.col("utc"))).alias("fall_back"),
    )
