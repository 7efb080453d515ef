"""The audit trail: building, cleaning, storing, paging and ageing events per tenant.

The store is partitioned by tenant and month, so a tenant's query reads that tenant only and an
erasure drops folders. A tenant may hold any share of the rows: writes are rebalanced and their
hot partitions split, and nothing groups a whole tenant into one task.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from harborlane import schemas
from harborlane.functions import text
from harborlane.functions.times import instant, month_text, utc_of_iso
from harborlane.sources.tables import matching

# Fixed values.
TENANT_PATTERN = "^[A-Za-z0-9-]+$"
HOT_DAYS = 90
WARM_YEARS = 2
MAX_PAGE = 500
STATE_COLUMNS = ["before_state", "after_state", "metadata_json"]
STORED_KEY = ["customer_guid", "event_month", "event_id"]
EMPTY_WHEN_MISSING = [
    "event_id", "event_type", "actor_id", "actor_type", "resource_type", "resource_id",
    "action", "outcome",
]


def build_events(
    df: DataFrame,
    now: Column,
    *,
    identity: list[Column],
    customer_guid: Column,
    event_type: Column,
    actor_id: Column,
    actor_type: Column,
    resource_type: Column,
    resource_id: Column,
    action: Column,
    outcome: Column,
    actor_ip: Column | None = None,
    before_state: Column | None = None,
    after_state: Column | None = None,
    trace_id: Column | None = None,
    request_id: Column | None = None,
    metadata: Column | None = None,
) -> DataFrame:
    """Audit events from any frame; states are structs or maps and become JSON text.

    The id comes from ``identity``, so a task that is run again makes the same event.
    """
    none = F.lit(None).cast("string")

    def json(value: Column | None) -> Column:
        return none if value is None else F.when(value.isNotNull(), F.to_json(value))

    return df.select(
        text.stable_uuid(event_type, *identity).alias("event_id"),
        now.alias("timestamp"),
        customer_guid.alias("customer_guid"),
        event_type.alias("event_type"),
        actor_id.alias("actor_id"),
        actor_type.alias("actor_type"),
        (none if actor_ip is None else actor_ip).alias("actor_ip"),
        resource_type.alias("resource_type"),
        resource_id.cast("string").alias("resource_id"),
        action.alias("action"),
        outcome.alias("outcome"),
        json(before_state).alias("before_state"),
        json(after_state).alias("after_state"),
        (none if trace_id is None else trace_id).alias("trace_id"),
        (none if request_id is None else request_id).alias("request_id"),
        json(metadata).alias("metadata_json"),
    )


def from_topic(records: DataFrame) -> DataFrame:
    """Audit events out of topic records, the time read as ISO text.

    A message that does not parse becomes an event without a tenant, so the ingest job rejects it;
    ``raw`` keeps the whole text of messages without a tenant. An event without a time has the
    record's, which is the same when the record is delivered again, in another month too.
    """
    fields = ", ".join(f"{name} string" for name in schemas.AUDIT_EVENT.names)
    event = F.from_json("value", fields)
    at = "timestamp" if "timestamp" in records.columns else F.lit(None).cast("timestamp_ntz").alias("timestamp")
    opened = records.where(F.col("value").isNotNull()).select("value", at, event.alias("e"))
    columns = {name: F.col(f"e.{name}") for name in schemas.AUDIT_EVENT.names}
    columns["timestamp"] = F.coalesce(utc_of_iso(columns["timestamp"]), F.col("timestamp"))
    columns["raw"] = F.when(columns["customer_guid"].isNull(), F.col("value"))
    return opened.select(*[column.alias(name) for name, column in columns.items()])


def tenant_error(guid: Column) -> Column:
    """Why a tenant id cannot be stored, or null."""
    missing = F.coalesce(guid, F.lit("")).isin("", "unknown")
    return F.when(missing, F.lit("missing tenant")).when(
        ~guid.rlike(TENANT_PATTERN), F.lit("invalid tenant")
    )


def check_tenant(customer_guid: str | None) -> str:
    """The id of a tenant; an id that could name anything else is refused."""
    if not re.fullmatch(TENANT_PATTERN.strip("^$"), customer_guid or ""):
        raise ValueError(f"not a tenant id: {customer_guid!r}")
    return customer_guid


def tenant_store_name(guid: Column) -> Column:
    """The name a tenant's store goes by; null for an id that is not allowed."""
    return F.when(
        guid.rlike(TENANT_PATTERN), F.concat(F.lit("audit_"), F.replace(guid, F.lit("-"), F.lit("_")))
    )


def keyed(events: DataFrame, now: Column) -> DataFrame:
    """Events with what decides where they are stored: a time, an id, ``reject_reason`` and the month.

    Cheap beside ``clean``, which leaves these as they are, so events can be told apart before it.
    """
    filled = events.withColumns(
        {
            "event_id": F.coalesce(F.col("event_id"), F.lit("")),
            "timestamp": F.coalesce(F.col("timestamp"), now),
            "reject_reason": tenant_error(F.col("customer_guid")),
        }
    )
    return filled.withColumn("event_month", month_text(F.col("timestamp")))


def clean(events: DataFrame, now: Column) -> DataFrame:
    """Mask and truncate states, fill missing fields, and add ``reject_reason`` and the month.

    The ``raw`` text of a message, if there is one, is masked but not cut.
    """
    texts = [*STATE_COLUMNS, *(["raw"] if "raw" in events.columns else [])]
    masked = events.withColumns({c: text.mask_sensitive(F.col(c)) for c in texts})
    cleaned = masked.withColumns(
        {
            **{c: text.truncate_text(F.col(c)) for c in STATE_COLUMNS},
            **{c: F.coalesce(F.col(c), F.lit("")) for c in EMPTY_WHEN_MISSING},
        }
    )
    return keyed(cleaned, now)


def accepted(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("reject_reason").isNull()).drop("reject_reason", "raw")


def rejected(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("reject_reason").isNotNull())


def unique(events: DataFrame) -> DataFrame:
    """One row per tenant and event id; keyed by both, so a large tenant spreads over all tasks."""
    return events.dropDuplicates(["customer_guid", "event_id"])


def touched(batch: DataFrame) -> DataFrame:
    """The tenants and months in the batch."""
    return batch.select("customer_guid", "event_month").distinct()


def not_stored(batch: DataFrame, store: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Events of the batch that the store does not have yet.

    Only the tenants and months in the batch are read: the semi join on the partition columns
    prunes the store's folders at run time. A redelivered event has the same time, so the same
    month. ``folders`` is ``touched`` of the batch; a caller whose plans are not adaptive, as in a
    stream, passes it materialised, so that Spark knows its size when it plans the semi join.
    """
    if folders is None:
        folders = touched(batch)
    known = store.select("customer_guid", "event_month", "event_id").join(
        folders, ["customer_guid", "event_month"], "left_semi"
    )
    return batch.join(known, STORED_KEY, "left_anti")


def of_keys(events: DataFrame, keys: DataFrame) -> DataFrame:
    """The events whose stored key is among the keys."""
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"k.{c}")) for c in STORED_KEY]
    return events.alias("e").join(keys.alias("k"), reduce(lambda a, b: a & b, same), "left_semi")


def new_tenants(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Tenants in the batch that have no store yet."""
    return batch.select("customer_guid").distinct().join(
        known.select("customer_guid"), "customer_guid", "left_anti"
    )


def store_filter(
    customer_guid: str,
    event_type: str | None = None,
    resource_type: str | None = None,
    resource_id: str | None = None,
    actor_id: str | None = None,
    action: str | None = None,
    outcome: str | None = None,
    trace_id: str | None = None,
    from_ts: dt.datetime | None = None,
    to_ts: dt.datetime | None = None,
) -> Column:
    """Conjunction of the filters that are given; the time range includes both ends.

    A time range also filters the month partitions.
    """
    tests = [F.col("customer_guid") == customer_guid]
    equal = matching(
        event_type=event_type or None,
        resource_type=resource_type or None,
        resource_id=resource_id or None,
        actor_id=actor_id or None,
        action=action or None,
        outcome=outcome or None,
        trace_id=trace_id or None,
    )
    if equal is not None:
        tests.append(equal)
    for bound, is_lower in ((from_ts, True), (to_ts, False)):
        if bound is None:
            continue
        at = instant(bound)
        month = F.lit(bound.strftime("%Y-%m"))
        ts, part = F.col("timestamp"), F.col("event_month")
        tests.append((ts >= at) & (part >= month) if is_lower else (ts <= at) & (part <= month))
    return reduce(lambda a, b: a & b, tests)


def check_limit(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def page(
    store: DataFrame, test: Column, cursor: str | None = None, limit: int = 50
) -> DataFrame:
    """One page and the row after it, in id order: at most ``limit + 1`` rows.

    Spark keeps the smallest ids of each task and merges them; nothing is sorted in full.
    """
    check_limit(limit, MAX_PAGE)
    found = store.where(test)
    if cursor:
        found = found.where(F.col("event_id") > cursor)
    return found.select(*schemas.AUDIT_PAGE_COLUMNS).orderBy("event_id").limit(limit + 1)


def page_by_time(
    store: DataFrame,
    test: Column,
    cursor: tuple[dt.datetime, str] | None = None,
    limit: int = 50,
) -> DataFrame:
    """The same in time order, with (timestamp, id) as the cursor."""
    check_limit(limit, MAX_PAGE)
    found = store.where(test)
    if cursor:
        at = instant(cursor[0])
        ts = F.col("timestamp")
        found = found.where((ts > at) | ((ts == at) & (F.col("event_id") > cursor[1])))
    return (
        found.select(*schemas.AUDIT_PAGE_COLUMNS).orderBy("timestamp", "event_id").limit(limit + 1)
    )


def read_page(
    store: DataFrame, test: Column, cursor: str | None = None, limit: int = 50
) -> tuple[list[dict], str | None, bool]:
    """Rows, next cursor and whether there is more, from one collect of at most 501 rows."""
    rows = [row.asDict() for row in page(store, test, cursor, limit).collect()]
    more = len(rows) > limit
    rows = rows[:limit]
    return rows, rows[-1]["event_id"] if more else None, more


def tenants(store: DataFrame) -> DataFrame:
    return store.select("customer_guid").distinct()


def without_tenant(store: DataFrame, customer_guid: str) -> DataFrame:
    """The store as it is after the tenant's erasure."""
    return store.where(~F.col("customer_guid").eqNullSafe(F.lit(customer_guid)))


def trace_timeline(store: DataFrame, customer_guid: str, trace_id: str) -> DataFrame:
    """A tenant's events of one trace in time order.

    Trace ids come from callers and may be the same for two tenants. Only the tenant's folder is read.
    """
    own = (F.col("customer_guid") == customer_guid) & (F.col("trace_id") == trace_id)
    return store.where(own).orderBy("timestamp", "event_id")


def trace_summary(store: DataFrame) -> DataFrame:
    """Per tenant and trace: span, number of events and failures, first and last event.

    Everything is a partial aggregate, so a trace of any length is reduced before the shuffle.
    """
    at = F.struct("timestamp", "event_id")
    return (
        store.where(F.col("trace_id").isNotNull())
        .groupBy("customer_guid", "trace_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("outcome") == "failure").alias("failures"),
            F.min("timestamp").alias("first_at"),
            F.max("timestamp").alias("last_at"),
            F.min_by(F.col("event_type"), at).alias("first_event"),
            F.max_by(F.col("event_type"), at).alias("last_event"),
        )
    )


def _age_limit(now: Column) -> Column:
    return F.timestamp_add("YEAR", F.lit(-WARM_YEARS), now)


def is_security_event(event_type: Column) -> Column:
    """Changes of credentials and deletions keep their actor."""
    return event_type.startswith("auth.") | event_type.endswith(".deleted")


def with_tier(store: DataFrame, now: Column) -> DataFrame:
    ts = F.col("timestamp")
    hot = ts >= F.timestamp_add("DAY", F.lit(-HOT_DAYS), now)
    return store.withColumn(
        "tier", F.when(hot, "hot").when(ts >= _age_limit(now), "warm").otherwise("expired")
    )


def pseudonymise(store: DataFrame, now: Column) -> DataFrame:
    """Replace the actor of events older than two years by its hash, security events exempt."""
    old = (F.col("timestamp") < _age_limit(now)) & ~is_security_event(F.col("event_type"))
    return store.withColumn(
        "actor_id", F.when(old, text.pseudonym(F.col("actor_id"))).otherwise(F.col("actor_id"))
    )


def with_retention(
    store: DataFrame, overrides: DataFrame, now: Column, default_days: int = 730
) -> DataFrame:
    """Drop events past their tenant's retention; ``overrides`` is (customer_guid, keep_days)."""
    keep = overrides.select("customer_guid", "keep_days")
    days = F.coalesce("keep_days", F.lit(default_days))
    limit = F.timestamp_add("DAY", -days, now)
    return (
        store.join(keep, "customer_guid", "left")
        .where(F.col("timestamp") >= limit)
        .select(*store.columns)
    )
