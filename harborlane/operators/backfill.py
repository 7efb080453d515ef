"""Backfill plans: which missed runs to repeat, in which batch, and when to start each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harborlane.functions.times import millis_between
from harborlane.operators import positions

# Fixed values.
MAX_BACKFILL_DAYS = 7
MAX_RUNS_PER_INTEGRATION = 7
SKIP_OLDER_THAN_DAYS = 7
BATCH_SIZE = 10
INITIAL_DELAY = 5
MAX_DELAY = 120
STAGGER_MS = 100
JITTER_SECONDS = 5
DURATION_BUCKETS = [60, 300, 600, 1800, 3600, 7200]
STEP_DAYS = {"weekly": 7, "monthly": 30}


def step_days(schedule_type: Column) -> Column:
    step = F.lit(1)
    for kind, days in STEP_DAYS.items():
        step = F.when(schedule_type == kind, days).otherwise(step)
    return step


def skip_reason(now: Column, older_than: int = SKIP_OLDER_THAN_DAYS) -> Column:
    """Why an integration gets no backfill, or null."""
    late_days = F.extract(F.lit("DAY"), now - F.col("utc_next_run"))
    return F.when(F.col("usr_sch_status") != "active", F.lit("inactive")).when(
        late_days > older_than, F.lit("too old")
    )


def missed_runs(
    integrations: DataFrame,
    now: Column,
    max_days: int = MAX_BACKFILL_DAYS,
    max_runs: int = MAX_RUNS_PER_INTEGRATION,
    keep: str = "last",
) -> DataFrame:
    """Run times in [max(next run, now - max_days), now), at most ``max_runs`` per integration.

    ``keep`` says which end stays when there are more. The list is never longer than the window
    allows, so the explode is bounded.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    start = F.greatest(F.col("utc_next_run"), F.timestamp_add("DAY", F.lit(-max_days), now))
    step = step_days(F.col("schedule_type"))
    # Steps that start strictly before now; a part of a millisecond counts as a whole one.
    late = millis_between(start, F.timestamp_add("MICROSECOND", F.lit(999), now))
    count = F.ceil(late / (step.cast("bigint") * 86_400_000)).cast("int")
    first = F.greatest(count - max_runs, F.lit(0)) if keep == "last" else F.lit(0)
    last = count - 1 if keep == "last" else F.least(count, F.lit(max_runs)) - 1
    due = integrations.where(F.col("utc_next_run") < now)
    return due.select(
        "*", F.explode(F.sequence(first, last)).alias("_i")
    ).select(
        "*", F.timestamp_add("DAY", F.col("_i") * step, start).alias("missed_run")
    ).drop("_i")


def batch_start(batch: Column, initial: int = INITIAL_DELAY, most: int = MAX_DELAY) -> Column:
    """Seconds from the start until batch number ``batch`` (from 0) begins.

    The delay doubles until it reaches ``most`` and stays there, so the sum is a closed form.
    """
    doublings = 0
    while initial * 2**doublings < most:
        doublings += 1
    growing = initial * (2**doublings - 1)
    return F.when(
        batch <= doublings, initial * (F.pow(F.lit(2.0), batch) - 1)
    ).otherwise(growing + most * (batch - doublings)).cast("bigint")


def jitter(identity: Column, width: Column | int = JITTER_SECONDS) -> Column:
    """Repeatable offset in [-width, width] seconds."""
    n = F.lit(width) if isinstance(width, int) else width
    # Both factors are reduced first, so ids of any size stay within 64 bits.
    span = (2 * n + 1).cast("bigint")
    factor = F.pmod(F.lit(2654435761), span)
    return (F.pmod(F.pmod(identity, span) * factor, span) - n).cast("int")


def stagger_ms(position: Column, interval: int = STAGGER_MS) -> Column:
    return position * interval


def plan(
    integrations: DataFrame,
    now: Column,
    batch_size: int = BATCH_SIZE,
    jitter_seconds: int = JITTER_SECONDS,
    keep: str = "last",
) -> DataFrame:
    """The whole plan: skip, missed runs, batch, start offset, jitter and stagger.

    Runs are ordered by integration and time; each integration has at most seven.
    """
    wanted = integrations.where(skip_reason(now).isNull())
    missed = missed_runs(wanted, now, keep=keep).select(
        "integration_id", "workspace_id", "schedule_type", "missed_run"
    )
    placed = positions.with_position(missed, "integration_id", [F.col("missed_run")])
    batch = F.expr(f"position div {batch_size}")
    in_batch = F.col("position") % batch_size
    offset = jitter(F.col("integration_id"), jitter_seconds)
    delay = batch_start(F.col("batch"))
    at = F.timestamp_add("SECOND", (F.col("start_offset") + F.col("jitter")).cast("int"), now)
    return (
        placed.withColumn("batch", batch)
        .withColumn("start_offset", delay)
        .withColumn("jitter", offset)
        .withColumn("stagger_ms", stagger_ms(in_batch))
        .withColumn(
            "trigger_at",
            F.timestamp_add("MILLISECOND", F.col("stagger_ms").cast("int"), at),
        )
        .withColumn(
            "jittered_run", F.timestamp_add("SECOND", F.col("jitter"), F.col("missed_run"))
        )
    )


def jitter_by_load(missed: DataFrame, forecast: DataFrame, now: Column) -> DataFrame:
    """Jitter whose width follows the load forecast for the run's hour.

    The forecast has at most 720 rows, one per hour of its 30 days, so it is broadcast.
    """
    from harborlane.operators import forecast as load

    hours = forecast.select(
        F.hour("timestamp").alias("_hour"), F.col("total_dag_runs").alias("_runs")
    ).groupBy("_hour").agg(F.max("_runs").alias("hour_load"))
    width = load.jitter_width(F.coalesce("hour_load", F.lit(0)))
    return (
        missed.withColumn("_hour", F.hour("missed_run"))
        .join(F.broadcast(hours), "_hour", "left")
        .drop("_hour")
        .withColumn("jitter", jitter(F.col("integration_id"), width))
    )


def metrics(runs: DataFrame) -> DataFrame:
    """Per integration type and status: runs, and how many took at most each bucket's seconds.

    ``runs`` has integration_type, status and duration_seconds (null while running).
    """
    seconds = F.col("duration_seconds")
    return runs.groupBy("integration_type", "status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(seconds.isNull()).alias("pending"),
        *[F.count_if(seconds <= edge).alias(f"le_{edge}") for edge in DURATION_BUCKETS],
    )


def skipped(integrations: DataFrame, now: Column) -> DataFrame:
    """How many integrations a plan leaves out, by reason."""
    reason = skip_reason(now)
    return integrations.where(
        reason.isNotNull() & F.col("utc_next_run").isNotNull()
    ).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
