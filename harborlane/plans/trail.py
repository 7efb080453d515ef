"""Queries over the audit trail."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from harborlane import schemas
from harborlane.functions.times import instant as at
from harborlane.operators import audit
from harborlane.plans.registry import query
from harborlane.session import fresh_dir
from harborlane.sources import views
from harborlane.sources.tables import table
from harborlane.streaming import jobs

NOW = "2024-02-01 00:00:00"
IN_TWO_YEARS = "2026-01-16 00:00:00"

_PAGE = ", ".join(schemas.AUDIT_PAGE_COLUMNS)


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return audit.clean(views.audit_events(spark, folder), at(NOW))


def _store(spark: SparkSession, folder: str) -> DataFrame:
    return audit.unique(audit.accepted(_clean(spark, folder)))


@query(
    "audit_cleaned",
    views="raw_audit",
    sql="""select * exclude (copy), case when customer_guid in ('unknown', '') then 'missing tenant'
      when customer_guid = 'bad guid!' then 'invalid tenant' end as reject_reason from raw_audit""",
)
def audit_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(spark, folder)


@query(
    "audit_from_topic",
    sql="""select case when event_id % 17 <> 0 then cast(event_id as varchar) end as event_id,
      case when event_id % 17 = 0 or event_id % 19 = 0 then ts + interval 1 hour else ts end as timestamp,
      case when event_id % 17 <> 0 then 'cust-' || user_id % 5 end as customer_guid,
      case when event_id % 17 <> 0 then event_type end as event_type,
      case when event_id % 17 <> 0 then props end as metadata_json,
      case when event_id % 17 = 0 then '{cut' end as raw from events""",
)
def audit_from_topic(spark: SparkSession, folder: str) -> DataFrame:
    return audit.from_topic(views.audit_records(spark, folder)).select(
        "event_id", "timestamp", "customer_guid", "event_type", "metadata_json", "raw"
    )


@query(
    "audit_rejected",
    views="raw_audit",
    sql="""select case when customer_guid = 'bad guid!' then 'invalid tenant' else 'missing tenant' end
      as reject_reason, count(*) as n from raw_audit
      where customer_guid in ('unknown', '', 'bad guid!') group by 1""",
)
def audit_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return audit.rejected(_clean(spark, folder)).groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("audit_unique", views="stored_audit", sql="select * exclude (copy) from stored_audit")
def audit_unique(spark: SparkSession, folder: str) -> DataFrame:
    return _store(spark, folder)


@query(
    "audit_not_stored",
    views="stored_audit",
    sql="""select customer_guid, event_id from stored_audit where event_type <> 'auth.created'""",
)
def audit_not_stored(spark: SparkSession, folder: str) -> DataFrame:
    batch = _store(spark, folder)
    stored = audit.accepted(_clean(spark, folder)).where(F.col("event_type") == "auth.created")
    return audit.not_stored(batch, stored).select("customer_guid", "event_id")


@query(
    "audit_new_tenants",
    views="stored_audit customers",
    sql="""select distinct customer_guid from stored_audit where customer_guid not in
      (select customer_guid from customers where name < 'ASIA')""",
)
def audit_new_tenants(spark: SparkSession, folder: str) -> DataFrame:
    known = views.customers(spark, folder).where(F.col("name") < "ASIA")
    return audit.new_tenants(audit.accepted(_clean(spark, folder)), known)


_FILTER_SQL = """customer_guid = 'cust-2' and outcome = 'success' and resource_type = 'integration'
  and timestamp >= timestamp '2024-01-03 00:00:00' and timestamp <= timestamp '2024-01-25 00:00:00'"""


def _filter():
    return audit.store_filter(
        "cust-2",
        outcome="success",
        resource_type="integration",
        from_ts=dt.datetime(2024, 1, 3),
        to_ts=dt.datetime(2024, 1, 25),
    )


@query(
    "audit_page",
    views="stored_audit",
    sql=f"""select {_PAGE} from stored_audit where {_FILTER_SQL} and event_id > 'ev-000000000200'
      order by event_id limit 51""",
)
def audit_page(spark: SparkSession, folder: str) -> DataFrame:
    return audit.page(_store(spark, folder), _filter(), cursor="ev-000000000200")


@query(
    "audit_page_by_time",
    views="stored_audit",
    sql=f"""select {_PAGE} from stored_audit where {_FILTER_SQL}
      and (timestamp, event_id) > (timestamp '2024-01-04 00:00:00', 'ev-000000000000')
      order by timestamp, event_id limit 101""",
)
def audit_page_by_time(spark: SparkSession, folder: str) -> DataFrame:
    return audit.page_by_time(
        _store(spark, folder),
        _filter(),
        cursor=(dt.datetime(2024, 1, 4), "ev-000000000000"),
        limit=100,
    )


@query(
    "audit_tenants",
    views="stored_audit",
    sql="""select distinct customer_guid, 'audit_' || replace(customer_guid, '-', '_') as store_name
      from stored_audit""",
)
def audit_tenants(spark: SparkSession, folder: str) -> DataFrame:
    found = audit.tenants(audit.accepted(_clean(spark, folder)))
    return found.withColumn("store_name", audit.tenant_store_name(F.col("customer_guid")))


@query(
    "audit_erased",
    views="stored_audit",
    sql="""select customer_guid, count(*) as n from stored_audit where customer_guid <> 'cust-1' group by 1""",
)
def audit_erased(spark: SparkSession, folder: str) -> DataFrame:
    """A store of two segments, from which a tenant is deleted."""
    store = jobs.audit_store(spark, fresh_dir(spark, "erased"))
    events = _store(spark, folder)
    early = F.col("timestamp") < at("2024-01-15 00:00:00")
    store.write(events.where(early), "b-1")
    store.write(events.where(~early), "b-2")
    store.erase(customer_guid="cust-1")
    return store.read().groupBy("customer_guid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_trace_summary",
    views="stored_audit",
    sql="""select customer_guid, trace_id, count(*) as events,
      count(*) filter (where outcome = 'failure') as failures,
      min(timestamp) as first_at, max(timestamp) as last_at,
      arg_min(event_type, (timestamp, event_id)) as first_event,
      arg_max(event_type, (timestamp, event_id)) as last_event
    from stored_audit group by 1, 2""",
)
def audit_trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    return audit.trace_summary(_store(spark, folder))


@query(
    "audit_trace_timeline",
    views="stored_audit",
    sql="""select customer_guid, event_id, timestamp, event_type from stored_audit
      where trace_id = 'trace-7' and customer_guid = 'cust-2'""",
)
def audit_trace_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return audit.trace_timeline(_store(spark, folder), "cust-2", "trace-7").select(
        "customer_guid", "event_id", "timestamp", "event_type"
    )


@query(
    "audit_tiers",
    views="stored_audit",
    sql="""select case when timestamp >= timestamp '2024-04-10 00:00:00' - interval 90 day then 'hot' else 'warm' end
      as tier, event_month, count(*) as n from stored_audit group by 1, 2""",
)
def audit_tiers(spark: SparkSession, folder: str) -> DataFrame:
    tiers = audit.with_tier(_store(spark, folder), at("2024-04-10 00:00:00"))
    return tiers.groupBy("tier", "event_month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_pseudonyms",
    views="stored_audit",
    sql=f"""select event_id, case when timestamp < timestamp '{IN_TWO_YEARS}' - interval 2 year
      and event_type not like 'auth.%' then sha256(actor_id) else actor_id end as actor_id from stored_audit""",
)
def audit_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return audit.pseudonymise(_store(spark, folder), at(IN_TWO_YEARS)).select(
        "event_id", "actor_id"
    )


@query(
    "audit_retention",
    views="stored_audit",
    sql="""select customer_guid, count(*) as n from stored_audit
      where timestamp >= timestamp '2024-02-01 00:00:00'
        - to_days(cast(case when customer_guid = 'cust-0' then 30 else 10 + right(customer_guid, 1)::int end as int))
      group by 1""",
)
def audit_retention(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "region").where(F.col("r_regionkey") > 0)
    overrides = keys.select(
        F.concat(F.lit("cust-"), F.col("r_regionkey").cast("string")).alias("customer_guid"),
        (F.col("r_regionkey") + 10).alias("keep_days"),
    )
    kept = audit.with_retention(_store(spark, folder), overrides, at(NOW), default_days=30)
    return kept.groupBy("customer_guid").agg(F.count(F.lit(1)).alias("n"))
