"""The dead-letter store: views, status changes, replay, expiry and rates.

Changes return the new version of the rows they are given. A table in buckets (``sinks.buckets``) gives
them the rows of the buckets they touch: ``change`` those of some ids, ``change_where`` those of a test.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from harborlane import schemas
from harborlane.functions.times import instant
from harborlane.operators import changes
from harborlane.operators.audit import check_limit
from harborlane.sources.tables import matching

MAX_PAGE = 200
RATE_LIMIT = 10


def check_status(status: str) -> str:
    if status not in schemas.DEAD_LETTER_STATUSES:
        raise ValueError(f"unknown status {status}")
    return status


def listing(
    letters: DataFrame,
    status: str | None = None,
    integration_id: int | None = None,
    created_after: dt.datetime | None = None,
    created_before: dt.datetime | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Newest first, the id breaking ties; a page is cut in each task before the merge."""
    check_limit(limit, MAX_PAGE)
    if status is not None:
        check_status(status)
    tests = [matching(status=status, integration_id=integration_id)]
    if created_after is not None:
        tests.append(F.col("created_at") >= instant(created_after))
    if created_before is not None:
        tests.append(F.col("created_at") <= instant(created_before))
    tests = [t for t in tests if t is not None]
    found = letters.where(reduce(lambda a, b: a & b, tests)) if tests else letters
    ordered = found.orderBy(F.desc("created_at"), F.desc("dlq_id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def get(letters: DataFrame, dlq_id: int) -> DataFrame:
    return with_document(letters.where(F.col("dlq_id") == dlq_id))


def with_document(letters: DataFrame) -> DataFrame:
    """Add the stored message as a document; text that is not JSON becomes a JSON string."""
    stored = F.col("original_message")
    return letters.withColumn(
        "document", F.coalesce(F.try_parse_json(stored), stored.cast("variant"))
    )


def counts_by_status(letters: DataFrame) -> DataFrame:
    return letters.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def total_pending(letters: DataFrame) -> DataFrame:
    return letters.agg(F.count_if(F.col("status") == "pending").alias("total_pending"))


def failure_patterns(letters: DataFrame, every: str = "1 day") -> DataFrame:
    """Failures per time window, integration and error type."""
    start = F.window("created_at", every)["start"]
    return letters.groupBy(start.alias("window_start"), "integration_id", "error_type").agg(
        F.count(F.lit(1)).alias("n")
    )


def rates(
    letters: DataFrame, width: str = "5 minutes", slide: str = "1 minute", above: int = RATE_LIMIT
) -> DataFrame:
    """Sliding windows with more dead letters than the limit, for batch or stream.

    The width is a whole number of slides.
    """
    n = F.count(F.lit(1))
    if not letters.isStreaming:  # counted per slide, so a letter is not copied for every window
        start = F.window("created_at", slide)["start"]
        letters = letters.groupBy(start.alias("created_at")).agg(n.alias("n"))
        n = F.sum("n")
    window = F.window("created_at", width, slide)
    counted = letters.groupBy(window.alias("w")).agg(n.alias("n"))
    return counted.where(F.col("n") > above).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )


def transition(
    letters: DataFrame,
    hit: Column,
    status: str | Column,
    now: Column,
    notes: str | Column | None = None,
    error_type: Column | None = None,
    error_message: Column | None = None,
    increment_retry: bool | Column = False,
) -> DataFrame:
    """Rows where ``hit`` is true get the status and time; resolved rows get ``resolved_at``."""
    target = F.lit(check_status(status)) if isinstance(status, str) else status
    hit = F.coalesce(hit, F.lit(False))

    def set_if(column: str, value: Column | None, test: Column | None = None) -> Column:
        if value is None:
            return F.col(column)
        test = hit if test is None else hit & F.coalesce(test, F.lit(False))
        return F.when(test, value).otherwise(F.col(column))

    def optional(column: str, value: Column | None) -> Column:
        return set_if(column, value, None if value is None else value.isNotNull())

    more = F.lit(increment_retry) if isinstance(increment_retry, bool) else increment_retry
    note = F.lit(notes) if isinstance(notes, str) else notes
    return letters.withColumns(
        {
            "status": set_if("status", target),
            "updated_at": set_if("updated_at", now),
            "resolved_at": set_if("resolved_at", now, target == "resolved"),
            "resolution_notes": optional("resolution_notes", note),
            "error_type": optional("error_type", error_type),
            "error_message": optional("error_message", error_message),
            "retry_count": set_if("retry_count", F.col("retry_count") + 1, more),
        }
    )


def bulk_transition(
    letters: DataFrame, ids: DataFrame, status: str, now: Column, notes: str | None = None
) -> DataFrame:
    """The same for the letters whose ``dlq_id`` is in ``ids``; any number of them."""
    wanted = ids.select("dlq_id").distinct().withColumn("_hit", F.lit(True))
    marked = letters.join(wanted, "dlq_id", "left")
    return transition(marked, F.col("_hit"), status, now, notes).select(*letters.columns)


def replay(
    letters: DataFrame,
    ids: DataFrame,
    integrations: DataFrame,
    workspaces: DataFrame,
    auths: DataFrame,
    now: Column,
    notes: str = "Automatically resolved via bulk retry",
) -> DataFrame:
    """Send the letters in ``ids`` through the change job once more.

    One row per id: the outcome ``not_found``, ``already_resolved``, ``resolved`` or ``failed`` with
    the error, and the run request of a letter that starts a run. Letters are read, parsed and
    joined to their integration once; write the result before using it for more than one output.
    """
    found = ids.select("dlq_id").distinct().join(letters, "dlq_id", "left")
    records = found.select(
        "dlq_id",
        "status",
        F.col("original_message").isNull().alias("_absent"),
        F.col("source_topic").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("dlq_id").alias("offset"),
        F.col("created_at").alias("timestamp"),
        # An id without a letter has to pass the parse, which drops tombstones.
        F.coalesce("original_message", F.lit("")).alias("value"),
        F.lit(None).cast(schemas.TOPIC_RECORD["headers"].dataType).alias("headers"),
    )
    absent, done = F.col("_absent"), F.coalesce(F.col("status") == "resolved", F.lit(False))
    runs = ~absent & ~done & (F.col("route") == "trigger")
    events = changes.parse(records, ["dlq_id", "status", "_absent"]).withColumn("_runs", runs)
    # Letters that start nothing meet no integration.
    events = events.withColumn("integration_id", F.when(F.col("_runs"), F.col("integration_id")))
    tried = changes.with_request(
        events, integrations, workspaces, auths, now,
        ["dlq_id", "status", "reason", "_absent", "_runs"],
    )
    reason = F.when(
        ~absent & ~done, F.coalesce("reason", F.when(F.col("_runs"), F.col("error")))
    )
    outcome = (
        F.when(absent, "not_found")
        .when(done, "already_resolved")
        .when(reason.isNotNull(), "failed")
        .otherwise("resolved")
    )
    starts = F.col("_runs") & F.col("error").isNull()
    return tried.select(
        "dlq_id",
        outcome.alias("outcome"),
        F.when(reason.isNotNull(), changes.error_type_of(reason)).alias("error_type"),
        reason.alias("error_message"),
        F.when(outcome == "resolved", F.lit(notes)).alias("notes"),
        *[F.when(starts, F.col(name)).alias(name) for name in changes.REQUEST_COLUMNS],
    )


def replay_requests(outcomes: DataFrame) -> DataFrame:
    """Run requests of the letters that a replay resolved, in the shape of the change job's."""
    return outcomes.where(F.col("dag_run_id").isNotNull()).select(*changes.REQUEST_COLUMNS)


def apply_replay(letters: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The table after a replay: resolved, or pending again with one more try and the new error."""
    tried = outcomes.where(F.col("outcome").isin("resolved", "failed")).select(
        "dlq_id",
        F.col("outcome").alias("_outcome"),
        F.col("error_type").alias("_type"),
        F.col("error_message").alias("_message"),
        F.col("notes").alias("_notes"),
    )
    marked = letters.join(tried, "dlq_id", "left")
    failed = F.col("_outcome") == "failed"
    return transition(
        marked,
        F.col("_outcome").isNotNull(),
        F.when(failed, "pending").otherwise("resolved"),
        now,
        notes=F.col("_notes"),
        error_type=F.col("_type"),
        error_message=F.col("_message"),
        increment_retry=failed,
    ).select(*letters.columns)


def expire(
    letters: DataFrame, now: Column, resolved_days: int = 30, pending_days: int = 90
) -> DataFrame:
    """Mark old letters expired: resolved ones by their resolution, open ones by their creation."""
    return transition(letters, is_old(now, resolved_days, pending_days), "expired", now)


def is_old(now: Column, resolved_days: int = 30, pending_days: int = 90) -> Column:
    def before(days: int) -> Column:
        return F.timestamp_add("DAY", F.lit(-days), now)

    status = F.col("status")
    return ((status == "resolved") & (F.col("resolved_at") < before(resolved_days))) | (
        status.isin("pending", "retrying") & (F.col("created_at") < before(pending_days))
    )
