"""Hourly load forecast, hotspots and capacity.

One scan of the schedules makes at most a thousand counts, whatever the number of tenants: one
per hour, per weekday and hour, and per day of month and hour. Everything after that is small.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborlane.functions import cron
from harborlane.functions.times import instant, seconds_between, start_of_hour, utc_of_iso

# Fixed values.
HOTSPOT_THRESHOLD = 100
ONDEMAND_SHARE = 0.05
MAX_DAYS = 30
MONDAY_MIDNIGHT = "Monday midnight: daily + weekly + monthly convergence"
MONDAY_MIDNIGHT_ADVICE = [
    "Apply ±5 second jitter to randomize triggers",
    "Stagger triggers with 100ms interval between integrations",
    "Scale workers to 50+ with KEDA",
]
FIRST_OF_MONTH = "First of month midnight: daily + monthly convergence"
FIRST_OF_MONTH_ADVICE = [
    "Apply ±5 second jitter",
    "Use exponential backoff for batch triggering",
]
MONDAY = "Monday: daily + weekly convergence"
MONDAY_ADVICE = ["Apply ±3 second jitter", "Stagger weekly triggers"]
HIGH_DAILY_ADVICE = [
    "Consider distributing integrations across more hours",
    "Apply jitter to prevent exact-time clustering",
]
GENERAL_ADVICE = ["Apply standard jitter and staggering"]

_ANY = -1  # in place of a day or hour that a count does not depend on


def check_days(days: int) -> int:
    if not 1 <= days <= MAX_DAYS:
        raise ValueError(f"days must be between 1 and {MAX_DAYS}")
    return days


def start_or_now(text: Column, now: Column) -> Column:
    """ISO start time, ``Z`` accepted; the hour of ``now`` when it is missing or bad."""
    return F.coalesce(utc_of_iso(text), start_of_hour(now))


def schedule_counts(integrations: DataFrame) -> DataFrame:
    """(kind, day, hour, n) of the active schedules, plus one ``all`` row counting every active row.

    Rows whose text cannot be placed in an hour count in ``all`` only. One scan with partial
    aggregation gives at most 24 + 168 + 744 + 1 counts, and ``grouping sets`` adds their total.
    """
    text, kind = F.col("utc_sch_cron"), F.col("schedule_type")
    written = (F.coalesce(F.col("usr_sch_cron"), F.lit("")) != "") & (
        F.coalesce(text, F.lit("")) != ""
    )
    hour = cron.cron_hour(text, 2)
    day = (
        F.when(kind == "daily", F.lit(_ANY))
        .when(kind == "weekly", cron.weekday_of_cron_day(cron.cron_day_of_week(text)))
        .when(kind == "monthly", cron.cron_day_of_month(text, 3))
    )
    placed = written & hour.isNotNull() & day.isNotNull()
    slots = integrations.where(F.col("usr_sch_status") == "active").select(
        F.when(placed, kind).alias("kind"),
        F.when(placed, day.cast("int")).alias("day"),
        F.when(placed, hour).alias("hour"),
    )
    counts = slots.groupBy("kind", "day", "hour").agg(F.count(F.lit(1)).alias("n"))
    counted = counts.groupingSets(
        [[F.col("kind"), F.col("day"), F.col("hour")], []], "kind", "day", "hour"
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    everything = F.col("level") != 0
    return counted.select(
        F.when(everything, F.lit("all")).otherwise(F.coalesce("kind", F.lit("unplaced"))).alias("kind"),
        F.when(everything | F.col("kind").isNull(), F.lit(_ANY)).otherwise(F.col("day")).alias("day"),
        F.when(everything | F.col("kind").isNull(), F.lit(_ANY)).otherwise(F.col("hour")).alias("hour"),
        "n",
    )


def hour_spine(spark: SparkSession, start: dt.datetime, days: int) -> DataFrame:
    """Every hour from ``start`` for at most 30 days."""
    first = instant(start)
    steps = F.sequence(F.lit(0), F.lit(24 * check_days(days) - 1))
    return spark.range(1).select(F.explode(steps).alias("i")).select(
        F.timestamp_add("HOUR", F.col("i"), first).alias("timestamp")
    )


def hourly_forecast(
    integrations: DataFrame,
    start: dt.datetime,
    days: int = 10,
    threshold: int = HOTSPOT_THRESHOLD,
) -> DataFrame:
    """Runs expected in each hour, by kind, with the hotspot flag."""
    ts = F.col("timestamp")
    hour = F.hour(ts)
    keys = F.array(
        F.struct(F.lit("daily").alias("kind"), F.lit(_ANY).alias("day"), hour.alias("hour")),
        F.struct(F.lit("weekly").alias("kind"), F.weekday(ts).alias("day"), hour.alias("hour")),
        F.struct(F.lit("monthly").alias("kind"), F.day(ts).alias("day"), hour.alias("hour")),
        F.struct(F.lit("all").alias("kind"), F.lit(_ANY).alias("day"), F.lit(_ANY).alias("hour")),
    )
    spine = hour_spine(integrations.sparkSession, start, days).select(
        "timestamp", F.explode(keys).alias("k")
    ).select("timestamp", "k.*")
    # At most 938 rows by construction, so the broadcast cannot grow with the data.
    counts = F.broadcast(schedule_counts(integrations))

    def runs(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("bigint"))

    joined = spine.join(counts, ["kind", "day", "hour"], "left")
    per_hour = joined.groupBy("timestamp").agg(
        runs("daily").alias("daily_runs"),
        runs("weekly").alias("weekly_runs"),
        runs("monthly").alias("monthly_runs"),
        F.floor(runs("all") * F.lit(ONDEMAND_SHARE)).cast("bigint").alias("ondemand_potential"),
    )
    total = F.col("daily_runs") + F.col("weekly_runs") + F.col("monthly_runs")
    return per_hour.select(
        "timestamp",
        total.alias("total_dag_runs"),
        "daily_runs",
        "weekly_runs",
        "monthly_runs",
        "ondemand_potential",
        (total >= threshold).alias("is_hotspot"),
        F.lit(threshold).alias("hotspot_threshold"),
    )


def _advice(lines: list[str]) -> Column:
    return F.array(*[F.lit(line) for line in lines])


def classify_hotspots(forecast: DataFrame) -> DataFrame:
    """The hotspot hours with the first reason that applies and its suggestions."""
    ts = F.col("timestamp")
    monday, midnight = F.weekday(ts) == 0, F.hour(ts) == 0
    high_daily = F.col("daily_runs") > F.col("hotspot_threshold") * 0.8
    reason = (
        F.when(monday & midnight, F.lit(MONDAY_MIDNIGHT))
        .when((F.day(ts) == 1) & midnight, F.lit(FIRST_OF_MONTH))
        .when(monday, F.lit(MONDAY))
        .when(
            high_daily,
            F.concat(F.lit("High daily traffic: "), F.col("daily_runs").cast("string"), F.lit(" integrations")),
        )
        .otherwise(
            F.concat(F.lit("High traffic: "), F.col("total_dag_runs").cast("string"), F.lit(" runs"))
        )
    )
    advice = (
        F.when(monday & midnight, _advice(MONDAY_MIDNIGHT_ADVICE))
        .when((F.day(ts) == 1) & midnight, _advice(FIRST_OF_MONTH_ADVICE))
        .when(monday, _advice(MONDAY_ADVICE))
        .when(high_daily, _advice(HIGH_DAILY_ADVICE))
        .otherwise(_advice(GENERAL_ADVICE))
    )
    return forecast.where("is_hotspot").select(
        "timestamp",
        "total_dag_runs",
        reason.alias("reason"),
        advice.alias("mitigation_suggestions"),
    )


def _first_at_peak() -> Column:
    return F.min_by(
        F.col("timestamp"), F.struct(-F.col("total_dag_runs"), F.col("timestamp"))
    )


def statistics(forecast: DataFrame) -> DataFrame:
    hot = F.count_if(F.col("is_hotspot"))
    return forecast.agg(
        F.count(F.lit(1)).alias("total_hours"),
        F.avg("total_dag_runs").alias("average_runs_per_hour"),
        F.max("total_dag_runs").alias("max_runs_per_hour"),
        F.min("total_dag_runs").alias("min_runs_per_hour"),
        hot.alias("hotspot_hours"),
        (hot / F.count(F.lit(1)) * 100).alias("hotspot_percentage"),
        _first_at_peak().alias("peak_hour"),
    )


def summary(forecast: DataFrame, now: Column) -> DataFrame:
    """Next hotspot, how many there are, and the earliest of the highest; one row."""
    spots = classify_hotspots(forecast)
    order = F.struct(-F.col("total_dag_runs"), F.col("timestamp"))
    first = spots.agg(
        F.min("timestamp").alias("next_hotspot"),
        F.min_by("total_dag_runs", "timestamp").alias("next_total_dag_runs"),
        F.min_by("reason", "timestamp").alias("next_reason"),
        F.count(F.lit(1)).alias("hotspots_count"),
        F.min_by(F.col("timestamp"), order).alias("highest_load"),
        F.max("total_dag_runs").alias("highest_total_dag_runs"),
        F.min_by(F.col("reason"), order).alias("highest_reason"),
    )
    hours = seconds_between(now, F.col("next_hotspot")) / F.lit(3600.0)
    return first.withColumn("hours_until", F.round(hours, 1))


def imminent_overload(
    forecast: DataFrame, now: Column, hours: int = 2, above: int = 300
) -> DataFrame:
    """Hotspots that start within the next hours with more runs than the limit."""
    ts = F.col("timestamp")
    return forecast.where(
        F.col("is_hotspot")
        & (ts >= now)
        & (ts < F.timestamp_add("HOUR", F.lit(hours), now))
        & (F.col("total_dag_runs") > above)
    )


def jitter_width(total_runs: Column) -> Column:
    """Seconds of jitter by load."""
    return F.when(total_runs > 500, 10).when(total_runs > 300, 5).otherwise(0)


def worker_demand(
    integrations: DataFrame, now: Column, per_worker: int = 5, low: int = 2, high: int = 50
) -> DataFrame:
    """Scheduled integrations due in the next 24 hours, and the workers they ask for."""
    due = integrations.where(
        (F.col("usr_sch_status") == "active")
        & (F.col("schedule_type") != "on_demand")
        & F.col("utc_next_run").between(now, F.timestamp_add("HOUR", F.lit(24), now))
    ).agg(F.count(F.lit(1)).alias("due"))
    workers = F.ceil(F.col("due") / per_worker)
    return due.select(
        "due", F.least(F.lit(high), F.greatest(F.lit(low), workers)).cast("bigint").alias("workers")
    )
