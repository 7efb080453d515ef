from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborlane import schemas
from harborlane.functions import conf, cron
from harborlane.functions.times import instant
from harborlane.operators import backfill, dispatch, forecast, positions, schedule


def integration(i, **values):
    row = dict.fromkeys(schemas.INTEGRATIONS.names)
    row |= {
        "integration_id": i, "workspace_id": "ws-1", "integration_type": "S3ToMongo",
        "usr_sch_status": "active", "usr_timezone": "UTC", "schedule_type": "daily",
        "workflow_id": 1, "auth_id": 1, "source_access_pt_id": 1, "dest_access_pt_id": 2,
    }
    row |= values
    if "cron" in row:
        row["usr_sch_cron"] = row["utc_sch_cron"] = row.pop("cron")
    return tuple(row[name] for name in schemas.INTEGRATIONS.names)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.INTEGRATIONS)


def when(text):
    return dt.datetime.fromisoformat(text)


def test_cron_fields(spark):
    df = spark.createDataFrame(
        [("0 2 15 * *",), (" 0  2 * * 1 ",), ("0 * * * *",), ("every day",), ("0 2",), ("0 99 * * 9",), (None,)],
        "c string",
    )
    c = F.col("c")
    got = df.select(cron.cron_hour(c), cron.cron_day_of_month(c), cron.cron_day_of_week(c)).collect()
    assert [tuple(r) for r in got] == [
        (2, 15, None), (2, None, 1), (None, None, None), (None, None, None), (None, None, None),
        (None, None, None), (None, None, None),
    ]


def test_cron_days_and_weekdays(spark):
    df = spark.range(7).select(
        cron.weekday_of_cron_day(F.col("id").cast("int")).alias("w"),
        cron.cron_day_of_weekday(F.col("id").cast("int")).alias("c"),
    )
    assert [tuple(r) for r in df.collect()] == [
        (6, 1), (0, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 0),
    ]


@pytest.mark.parametrize(
    "kind,text,zone,now,expected,utc_cron",
    [
        ("daily", "0 2 * * *", "America/New_York", "2024-01-15 12:00:00", "2024-01-16 07:00:00", "0 7 * * *"),
        # 02:00 does not exist that day and moves to 03:00 summer time.
        ("daily", "0 2 * * *", "America/New_York", "2024-03-09 12:00:00", "2024-03-10 07:00:00", "0 7 * * *"),
        # Monday stays Monday.
        ("weekly", "0 2 * * 1", "UTC", "2024-01-15 01:00:00", "2024-01-15 02:00:00", "0 2 * * 1"),
        ("weekly", "0 2 * * 1", "UTC", "2024-01-15 02:00:00", "2024-01-22 02:00:00", "0 2 * * 1"),
        ("weekly", "0 23 * * 0", "America/New_York", "2024-01-15 12:00:00", "2024-01-22 04:00:00", "0 4 * * 1"),
        ("monthly", "0 2 31 * *", "UTC", "2024-01-31 03:00:00", "2024-03-31 02:00:00", "0 2 31 * *"),
        ("monthly", "0 2 15 * *", "UTC", "2024-12-20 00:00:00", "2025-01-15 02:00:00", "0 2 15 * *"),
    ],
)
def test_normalise(spark, kind, text, zone, now, expected, utc_cron):
    df = table(spark, integration(1, schedule_type=kind, cron=text, usr_timezone=zone))
    row = schedule.normalise(df, instant(now)).first()
    assert (row["utc_next_run"], row["utc_sch_cron"], row["sch_error"]) == (when(expected), utc_cron, None)


def test_normalise_errors(spark):
    df = table(
        spark,
        integration(1, cron="0 2 * * *", usr_timezone="Invalid/Zone"),
        integration(2, cron="whenever"),
        integration(3, cron="0 2 * * *", schedule_type="weekly"),
        integration(4, cron="0 2 * * *", schedule_type="monthly"),
        integration(5, schedule_type="on_demand"),
        integration(6, cron="0 2 * * *", usr_timezone=None),
    )
    rows = schedule.normalise(df, instant("2024-01-15 00:00:00")).orderBy("integration_id").collect()
    assert [r["sch_error"] for r in rows] == [
        "invalid timezone", "unparsed cron", "missing weekday", "missing day of month", None, None,
    ]
    assert [r["utc_next_run"] is None for r in rows] == [True] * 5 + [False]


def test_partial_update(spark):
    df = table(
        spark,
        integration(1, cron="0 2 * * *", utc_next_run=when("2024-01-16 02:00:00")),
        integration(2, cron="0 2 * * *", utc_next_run=when("2024-01-16 02:00:00"), json_data="x"),
        integration(3, cron="0 2 * * *", utc_next_run=when("2024-01-16 02:00:00")),
    )
    updates = spark.createDataFrame(
        [(1, "Asia/Tokyo", None, ["usr_timezone"]), (2, None, None, ["json_data"])],
        "integration_id long, usr_timezone string, json_data string, changed array<string>",
    )
    now = "2024-01-15 00:00:00"
    rows = schedule.apply_updates(df, updates, instant(now)).orderBy("integration_id").collect()
    assert rows[0]["utc_next_run"] == when("2024-01-15 17:00:00")
    assert (rows[1]["utc_next_run"], rows[1]["json_data"]) == (when("2024-01-16 02:00:00"), None)
    assert rows[1]["updated_at"] == when(now) and rows[2]["updated_at"] is None


@pytest.mark.parametrize(
    "kind,text,current,now,expected",
    [
        # Daily skips what it missed; weekly and monthly catch up one at a time.
        ("daily", "0 2 * * *", "2026-03-01 02:00:00", "2026-03-08 10:30:00", "2026-03-09 02:00:00"),
        ("weekly", "0 2 * * 1", "2026-03-09 02:00:00", "2026-03-30 10:00:00", "2026-03-16 02:00:00"),
        ("monthly", "0 2 15 * *", "2026-01-15 02:00:00", "2026-03-20 10:00:00", "2026-02-15 02:00:00"),
        ("daily", "broken", "2026-03-01 02:00:00", "2026-03-08 10:30:00", "2026-03-01 02:00:00"),
    ],
)
@pytest.mark.parametrize("frozen", [True, False])
def test_advance(spark, kind, text, current, now, expected, frozen):
    df = table(spark, integration(1, schedule_type=kind, cron=text, utc_next_run=when(current)))
    row = dispatch.advance_due(df, instant(now), frozen_offset=frozen).first()
    assert row["utc_next_run"] == when(expected)


def test_local_hour_survives_a_clock_change(spark):
    df = table(
        spark,
        integration(1, schedule_type="weekly", usr_sch_cron="0 2 * * 5", utc_sch_cron="0 7 * * 5",
                    usr_timezone="America/New_York", utc_next_run=when("2024-03-08 07:00:00")),
    )
    now = instant("2024-03-08 08:00:00")
    assert dispatch.advance_due(df, now).first()["utc_next_run"] == when("2024-03-15 06:00:00")
    frozen = dispatch.advance_due(df, now, frozen_offset=True).first()
    assert frozen["utc_next_run"] == when("2024-03-15 07:00:00")


def test_dispatch(spark):
    now = instant("2026-03-08 10:00:00")
    late = when("2026-03-08 02:00:00")
    df = table(
        spark,
        integration(1, cron="0 2 * * *", utc_next_run=late, json_data='{"s3_bucket":"my-bucket","n":1.50}'),
        integration(2, cron="0 2 * * *", utc_next_run=late, integration_type="s3_to_mongo", json_data="[1]"),
        integration(3, cron="0 2 * * *", utc_next_run=late, usr_sch_status="paused"),
        integration(4, cron="0 2 * * *", utc_next_run=when("2026-03-09 02:00:00")),
        integration(5, cron="0 2 * * *", utc_next_run=late, workspace_id="nowhere"),
        integration(6, cron="0 2 * * *", utc_next_run=late, integration_type="AzureToMongo"),
    )
    ws = spark.createDataFrame([("ws-1", "cust-1")], schemas.WORKSPACES)
    auths = spark.createDataFrame(
        [(1, "ws-1", "s3", '{"s3_access_key":"old","k":1}'), (2, "ws-1", "s3", '{"s3_access_key":"ak"}'),
         (3, "ws-1", "s3", "{broken"), (4, "ws-1", "s3", None)],
        schemas.AUTHS,
    )
    got = dispatch.due_requests(df, ws, auths, now, "s3_to_mongo").orderBy("integration_id").collect()
    assert [r["integration_id"] for r in got] == [1, 2]
    assert got[0]["trigger_run_id"].startswith("ws-1_s3_to_mongo_ondemand_scheduled_20260308_100000_0")
    import json

    first, second = json.loads(got[0]["conf"]), json.loads(got[1]["conf"])
    assert first["s3_bucket"] == "my-bucket" and first["s3_access_key"] == "ak" and first["k"] == 1
    assert first["tenant_id"] == "ws-1" and first["customer_guid"] == "cust-1"
    assert len(first["traceparent"].split("-")) == 4
    assert (got[0]["warning"], got[1]["warning"]) == (None, "json_data ignored")
    assert "s3_bucket" not in second
    assert got[0]["utc_next_run"] == when("2026-03-09 02:00:00")


def test_nothing_due(spark):
    ws = spark.createDataFrame([("ws-1", "cust-1")], schemas.WORKSPACES)
    auths = spark.createDataFrame([], schemas.AUTHS)
    assert dispatch.due_requests(table(spark, integration(1)), ws, auths, instant("2026-01-01 00:00:00")).count() == 0


def test_override_precedence(spark):
    df = table(spark, integration(1, json_data='{"a":1,"b":1,"c":1}'))
    auths = spark.createDataFrame([(1, "ws-1", "s3", '{"b":2,"c":2}')], schemas.AUTHS)
    overrides = spark.createDataFrame([(1, '{"c":3,"d":null}'), (9, None)], "integration_id long, run_config string")
    rows = dispatch.manual_request(df, auths, overrides, instant("2026-01-01 00:00:00")).orderBy("integration_id").collect()
    assert '"a":1,"auth_id":1,"b":2,"c":3,"d":null' in rows[0]["conf"]
    assert rows[1]["error"] == "integration not found" and rows[1]["conf"] is None
    bad = spark.createDataFrame([(1, "ws-1", "key", "{bad"), (2, "ws-1", "key", ""), (3, "ws-2", "key", '{"a":1}')], schemas.AUTHS)
    assert [tuple(r) for r in dispatch.ignored_credentials(bad).collect()] == [("ws-1", 1, "credentials ignored")]


def test_repeated_keys_in_any_session(spark):
    other = spark.newSession()
    other.conf.set(conf.REPEATED_KEYS, "false")
    text = other.createDataFrame([('{"a":1,"a":2}',)], "t string")
    jvm = spark._jvm.org.apache.spark.sql.classic.SparkSession
    jvm.setActiveSession(other._jsparkSession)
    try:
        assert text.select(conf.conf_text(conf.json_map(F.col("t")))).first()[0] == '{"a":2}'
    finally:
        jvm.setActiveSession(spark._jsparkSession)


def test_merge_and_names(spark):
    df = spark.createDataFrame(
        [('{"a":1}',), (None,), ("",), ("{bad",), ("[1]",), ('{"x":9}',)], "j string"
    ).withColumn("m", conf.json_map(F.col("j")))
    merged = df.select(conf.conf_text(conf.merge(conf.base_conf(x=F.lit(1)), F.col("m"))).alias("t"))
    assert [r["t"] for r in merged.collect()] == [
        '{"a":1,"x":1}', '{"x":1}', '{"x":1}', '{"x":1}', '{"x":1}', '{"x":9}',
    ]
    names = spark.createDataFrame([("S3ToMongo",), ("s3_to_mongo",), ("s3tomongo",)], "t string")
    got = names.select(conf.workflow_run_target(F.col("t")).alias("n")).collect()
    assert {r["n"] for r in got} == {"s3_to_mongo_ondemand"}


def fixture_schedules(spark):
    rows = [integration(i, cron=f"0 {i % 24} * * *") for i in range(240)]
    rows += [integration(1000 + i, schedule_type="weekly", cron="0 0 * * 1") for i in range(150)]
    rows += [integration(2000 + i, schedule_type="monthly", cron="0 0 1 * *") for i in range(50)]
    return table(spark, *rows)


def test_forecast_of_a_monday_first_of_month(spark):
    hours = forecast.hourly_forecast(fixture_schedules(spark), dt.datetime(2026, 6, 1), 2, 100)
    first = hours.orderBy("timestamp").first()
    assert first["timestamp"] == when("2026-06-01 00:00:00")
    assert (first["daily_runs"], first["weekly_runs"], first["monthly_runs"]) == (10, 150, 50)
    assert (first["total_dag_runs"], first["is_hotspot"], first["ondemand_potential"]) == (210, True, 22)
    spots = forecast.classify_hotspots(hours).collect()
    assert len(spots) == 1 and "Monday" in spots[0]["reason"] and len(spots[0]["mitigation_suggestions"]) >= 3
    assert hours.count() == 48


def test_forecast_statistics_and_summary(spark):
    hours = forecast.hourly_forecast(fixture_schedules(spark), dt.datetime(2026, 2, 3), 7)
    stats = forecast.statistics(hours).first()
    assert stats["total_hours"] == 168
    assert stats["min_runs_per_hour"] <= stats["average_runs_per_hour"] <= stats["max_runs_per_hour"]
    summary = forecast.summary(hours, instant("2026-02-03 00:00:00")).first()
    assert summary["hotspots_count"] == 1 and summary["hours_until"] == 144.0
    empty = forecast.hourly_forecast(table(spark, integration(1)), dt.datetime(2026, 2, 3), 1)
    none = forecast.summary(empty, instant("2026-02-03 00:00:00")).first()
    assert none["hotspots_count"] == 0 and none["next_hotspot"] is None


def test_forecast_reasons(spark):
    rows = [
        ("2026-06-01 00:00:00", 0), ("2026-07-01 00:00:00", 0), ("2026-06-08 05:00:00", 0),
        ("2026-06-09 05:00:00", 81), ("2026-06-09 06:00:00", 80),
    ]
    df = spark.createDataFrame(
        [(when(t), 120, d, 100, True) for t, d in rows],
        "timestamp timestamp_ntz, total_dag_runs long, daily_runs long, hotspot_threshold int, is_hotspot boolean",
    )
    got = [r["reason"] for r in forecast.classify_hotspots(df).orderBy("timestamp").collect()]
    assert got[0].startswith("Monday midnight") and got[1].startswith("Monday: daily")
    assert got[2] == "High daily traffic: 81 integrations" and got[3] == "High traffic: 120 runs"
    assert got[4].startswith("First of month")


def test_forecast_arguments(spark):
    with pytest.raises(ValueError):
        forecast.check_days(31)
    now = instant("2026-02-03 10:20:00")
    df = spark.createDataFrame([("2026-02-01T00:00:00Z",), ("soon",), (None,)], "s string")
    got = [r["t"] for r in df.select(forecast.start_or_now(F.col("s"), now).alias("t")).collect()]
    assert got == [when("2026-02-01 00:00:00"), when("2026-02-03 10:00:00"), when("2026-02-03 10:00:00")]


def test_worker_demand_bounds(spark):
    now = instant("2026-01-01 00:00:00")
    few = table(spark, integration(1, utc_next_run=when("2026-01-02 00:00:00")))
    many = table(spark, *[integration(i, utc_next_run=when("2026-01-01 00:00:00")) for i in range(400)])
    some = table(spark, *[integration(i, utc_next_run=when("2026-01-01 05:00:00")) for i in range(11)])
    got = [tuple(forecast.worker_demand(df, now).first()) for df in (few, many, some)]
    assert got == [(1, 2), (400, 50), (11, 3)]


@pytest.mark.parametrize("late,runs", [(3, 3), (7, 7), (30, 7)])
def test_missed_daily_runs(spark, late, runs):
    now = when("2026-03-08 10:00:00")
    df = table(spark, integration(1, cron="0 2 * * *", utc_next_run=now - dt.timedelta(days=late)))
    assert backfill.missed_runs(df, instant(now)).count() == runs
    planned = backfill.plan(df, instant(now)).count()
    assert planned == (0 if late > 7 else runs)


def test_missed_runs_keep(spark):
    now = when("2026-03-08 10:00:00")
    df = table(spark, integration(1, cron="x", utc_next_run=when("2026-03-01 10:00:01")))
    first = backfill.missed_runs(df, instant(now), max_runs=2, keep="first").collect()
    last = backfill.missed_runs(df, instant(now), max_runs=2).collect()
    assert [r["missed_run"].day for r in first] == [1, 2] and [r["missed_run"].day for r in last] == [6, 7]


def test_plan_batches(spark):
    now = when("2026-03-08 10:00:00")
    df = table(
        spark,
        *[integration(i, schedule_type="weekly", utc_next_run=now - dt.timedelta(hours=1)) for i in range(25)],
    )
    rows = backfill.plan(df, instant(now)).orderBy("position").collect()
    assert [r["batch"] for r in rows] == [0] * 10 + [1] * 10 + [2] * 5
    assert sorted({r["start_offset"] for r in rows}) == [0, 5, 15]
    assert [r["stagger_ms"] for r in rows[:3]] == [0, 100, 200]
    assert all(-5 <= r["jitter"] <= 5 for r in rows) and len({r["jitter"] for r in rows}) > 3


def test_batch_start_matches_the_running_sum(spark):
    for initial, most in ((5, 120), (1, 8), (7, 7), (3, 100)):
        got = [
            r["s"]
            for r in spark.range(20).orderBy("id").select(backfill.batch_start(F.col("id"), initial, most).alias("s")).collect()
        ]
        want, delay = [0], initial
        for _ in range(19):
            want.append(want[-1] + delay)
            delay = min(delay * 2, most)
        assert got == want


def test_positions_over_many_ranges(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5000).alias("k"), (F.col("id") % 3).alias("t"))
    got = positions.with_position(df, "k", [F.col("t")], width=3).orderBy("k", "t").collect()
    assert [r["position"] for r in got] == list(range(5000))


def test_backfill_edges(spark):
    from harborlane.operators import backfill

    ids = spark.createDataFrame([(0,), (1,), (4_000_000_000,), (2**62,), (-5,)], "i bigint")
    got = [r["j"] for r in ids.select(backfill.jitter(F.col("i"), 300).alias("j")).collect()]
    assert got == [(i * 2654435761) % 601 - 300 for i in (0, 1, 4_000_000_000, 2**62, -5)]
    rows = spark.sql(
        """select id, cast(next as timestamp_ntz) as utc_next_run, 'daily' as schedule_type
        from values (1, '2024-01-09 23:59:59.5'), (2, '2024-01-08 23:59:59.999999'),
                    (3, '2024-01-10 00:00:00'), (4, '2024-01-09 00:00:00') as t(id, next)"""
    )
    missed = backfill.missed_runs(rows, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    times = sorted((r["id"], str(r["missed_run"])) for r in missed.collect())
    assert times == [
        (1, "2024-01-09 23:59:59.500000"), (2, "2024-01-08 23:59:59.999999"),
        (2, "2024-01-09 23:59:59.999999"), (4, "2024-01-09 00:00:00"),
    ]
