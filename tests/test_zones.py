"""Golden dates: gaps, overlaps, hemispheres, leap day, year end."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborlane.functions import zones
from harborlane.functions.times import instant


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(text):
    return instant(text if len(text) > 10 else f"{text} 00:00:00")


def when(text):
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize(
    "local,zone,expected",
    [
        ("2024-01-15 12:00:00", "America/New_York", "2024-01-15 17:00:00"),
        ("2024-07-15 12:00:00", "America/New_York", "2024-07-15 16:00:00"),
        ("2024-02-29 12:00:00", "America/New_York", "2024-02-29 17:00:00"),
        ("2023-12-31 23:30:00", "America/New_York", "2024-01-01 04:30:00"),
        ("2024-03-09 02:00:00", "America/New_York", "2024-03-09 07:00:00"),
        ("2024-03-11 02:00:00", "America/New_York", "2024-03-11 06:00:00"),
        ("2024-11-02 01:30:00", "America/New_York", "2024-11-02 05:30:00"),
        ("2024-11-03 01:30:00", "America/New_York", "2024-11-03 05:30:00"),
        ("2024-11-04 01:30:00", "America/New_York", "2024-11-04 06:30:00"),
        ("2024-03-10 02:30:00", "America/New_York", "2024-03-10 07:30:00"),
        ("2024-04-07 01:45:00", "Australia/Lord_Howe", "2024-04-06 14:45:00"),
    ],
)
def test_local_to_utc(spark, local, zone, expected):
    assert one(spark, zones.to_utc(at(local), F.lit(zone))) == when(expected)


@pytest.mark.parametrize(
    "local,zone,expected",
    [
        ("2024-11-03 01:30:00", "America/New_York", "2024-11-03 06:30:00"),
        ("2024-11-03 03:30:00", "America/New_York", "2024-11-03 08:30:00"),
        # An overlap of half an hour.
        ("2024-04-07 01:45:00", "Australia/Lord_Howe", "2024-04-06 15:15:00"),
    ],
)
def test_second_occurrence(spark, local, zone, expected):
    assert one(spark, zones.to_utc(at(local), F.lit(zone), second=True)) == when(expected)


@pytest.mark.parametrize(
    "local,ambiguous,nonexistent",
    [
        ("2024-11-03 01:30:00", True, False),
        ("2024-11-03 03:30:00", False, False),
        ("2024-03-10 02:30:00", False, True),
        ("2024-03-10 01:30:00", False, False),
    ],
)
def test_overlap_and_gap(spark, local, ambiguous, nonexistent):
    zone = F.lit("America/New_York")
    assert one(spark, zones.is_ambiguous(at(local), zone)) is ambiguous
    assert one(spark, zones.is_nonexistent(at(local), zone)) is nonexistent


@pytest.mark.parametrize(
    "local,zone,strategy,expected",
    [
        ("2024-03-10 02:30:00", "America/New_York", "shift_forward", "2024-03-10 03:30:00"),
        ("2024-03-10 02:30:00", "America/New_York", "shift_backward", "2024-03-10 01:30:00"),
        ("2024-03-10 02:30:00", "America/New_York", "raise", None),
        ("2024-03-10 01:30:00", "America/New_York", "raise", "2024-03-10 01:30:00"),
        # A gap of two hours: an hour on is still in it, so the first minute after it.
        ("2024-03-31 01:30:00", "Antarctica/Troll", "shift_forward", "2024-03-31 03:00:00"),
        ("2024-03-31 02:30:00", "Antarctica/Troll", "shift_backward", "2024-03-31 00:59:00"),
        # A day that was left out: nothing within two hours, so the time stays.
        ("2011-12-30 10:00:00", "Pacific/Apia", "shift_forward", "2011-12-30 10:00:00"),
    ],
)
def test_gap_repair(spark, local, zone, strategy, expected):
    got = one(spark, zones.repair_gap(at(local), F.lit(zone), strategy))
    assert got == (when(expected) if expected else None)


def test_unknown_strategy_is_refused():
    with pytest.raises(ValueError):
        zones.repair_gap(None, None, "sideways")


@pytest.mark.parametrize(
    "utc,zone,expected",
    [
        ("2024-06-15 18:00:00", "Asia/Tokyo", "2024-06-16 03:00:00"),
        ("2024-06-15 13:00:00", "America/New_York", "2024-06-15 09:00:00"),
    ],
)
def test_utc_to_local(spark, utc, zone, expected):
    assert one(spark, zones.from_utc(at(utc), F.lit(zone))) == when(expected)


@pytest.mark.parametrize(
    "local,zone,offset,dst",
    [
        ("2024-01-15 12:00:00", "America/New_York", -5.0, False),
        ("2024-07-15 12:00:00", "America/New_York", -4.0, True),
        ("2024-01-15 12:00:00", "Australia/Sydney", 11.0, True),
        ("2024-07-15 12:00:00", "Australia/Sydney", 10.0, False),
        ("2024-07-15 12:00:00", "Asia/Kolkata", 5.5, False),
    ],
)
def test_offset_and_dst(spark, local, zone, offset, dst):
    assert one(spark, zones.offset_hours(at(local), F.lit(zone))) == offset
    assert one(spark, zones.is_dst(at(local), F.lit(zone))) is dst


def test_transition_days(spark):
    df = spark.createDataFrame(
        [("America/New_York",), ("America/Phoenix",), ("UTC",), ("Invalid/Zone",), ("UTC",)],
        "zone string",
    )
    rows = {r["zone"]: r for r in zones.dst_transitions(df, 2024).collect() if r["zone"]}
    ny = rows["America/New_York"]
    assert ny["spring_forward"].date() == dt.date(2024, 3, 10)
    assert ny["fall_back"].date() == dt.date(2024, 11, 3)
    for quiet in ("America/Phoenix", "UTC"):
        assert rows[quiet]["spring_forward"] is None and rows[quiet]["fall_back"] is None


def test_invalid_zone_gives_null_and_never_fails(spark):
    df = spark.createDataFrame([("Invalid/Zone",), (None,), ("UTC",)], "z string")
    got = df.select(
        zones.is_known_zone("z").alias("ok"),
        zones.to_utc(at("2024-01-01"), zones.known_zone("z")).alias("u"),
    ).collect()
    assert [r["ok"] for r in got] == [False, False, True]
    assert [r["u"] for r in got] == [None, None, when("2024-01-01 00:00:00")]


def test_every_known_zone_converts(spark):
    df = spark.createDataFrame([(z,) for z in zones.zone_names()], "z string")
    assert len(zones.zone_names()) > 400
    done = df.where(zones.to_utc(at("2024-01-01"), F.col("z")).isNull()).count()
    assert done == 0


def test_nothing_depends_on_the_session_zone(spark):
    """A session in a zone with clock changes gives the same differences, starts and texts."""
    from harborlane.functions import conf, times

    a, b = at("2024-03-09 22:30:00"), at("2024-03-10 12:00:00.250")
    columns = {
        "seconds": times.seconds_between(a, b),
        "back": times.millis_between(b, a),
        "midnight": times.midnight(b).cast("string"),
        "year": times.start_of("year", b).cast("string"),
        "hour": times.start_of_hour(at("2024-03-10 02:59:59")).cast("string"),
        "month": times.month_text(b),
        "run": conf.run_id(F.lit("t"), F.lit("w"), "s", b, F.lit(1)),
        "whole": conf.run_id(F.lit("t"), F.lit("w"), "s", a, F.lit(1)),
        "epoch": times.epoch_millis(b),
        "plain": times.utc_of_iso(F.lit("2024-03-10T02:30:00")).cast("string"),
        "z": times.utc_of_iso(F.lit("2024-03-10T02:30:00Z")).cast("string"),
        "offset": times.utc_of_iso(F.lit("2024-03-10T02:30:00.5+02:00")).cast("string"),
        "minus": times.utc_of_iso(F.lit("2024-03-10T02:30:00-0530")).cast("string"),
        "hours": times.utc_of_iso(F.lit("2024-03-10T02:30:00-05")).cast("string"),
        "day": times.utc_of_iso(F.lit("2024-03-10")).cast("string"),
        "bad": times.utc_of_iso(F.lit("soon")),
    }
    want = {
        "seconds": 48600, "back": -48600250, "midnight": "2024-03-10 00:00:00", "year": "2024-01-01 00:00:00",
        "hour": "2024-03-10 02:00:00", "month": "2024-03", "run": "t_w_s_20240310_120000_2_1",
        "whole": "t_w_s_20240309_223000_0_1", "epoch": 1710072000250,
        "plain": "2024-03-10 02:30:00", "z": "2024-03-10 02:30:00", "offset": "2024-03-10 00:30:00.5",
        "minus": "2024-03-10 08:00:00", "hours": "2024-03-10 07:30:00", "day": "2024-03-10 00:00:00", "bad": None,
    }
    try:
        for zone in ("UTC", "America/New_York", "Pacific/Apia"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()
            assert row == want, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
